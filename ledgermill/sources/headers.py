"""Resolve export headers to canonical names. Looks at names only, never at data."""

from __future__ import annotations

from dataclasses import dataclass, field

# Accepted header names by canonical column, best first.
TRANSACTION_ALIASES = {
    "txn_date": [
        "date", "txn_date", "transaction_date", "post_date", "posted_date", "effective_date", "value_date",
        "entry_date", "postdate", "valuedate", "bookdate", "effectivedate", "transdate", "txndate",
        "orderdate", "order_date", "settlementdate", "settlement_date",
    ],
    "txn_amount": [
        "amount", "total", "value", "net_amount", "gross_amount", "payment", "charge", "credit_amount",
        "debit_amount", "grossamount", "totalamount", "total_amount", "payout", "credit", "debit",
    ],
    "description": ["memo", "description", "details", "narrative", "desc"],
    "reference": ["reference", "ref", "trace", "id", "txn_id", "transaction_id"],
}
AMOUNT_NAMES = [
    "amount", "total", "value", "net_amount", "gross_amount", "payment", "charge", "amount_usd", "txn_amount",
    "transaction_amount", "grossamount", "totalamount", "total_amount", "payout", "credit", "debit",
]
CREDIT_NAMES = ["credit", "credit_amount", "cr_amount", "amount_credit"]
DEBIT_NAMES = ["debit", "debit_amount", "dr_amount", "amount_debit"]

PAYROLL_ALIASES = {
    "employee_id": ["employee_id", "emp_id", "employee number", "employee_number", "employee id"],
    "pay_date": ["pay_date", "paydate", "check_date", "payroll_date"],
    "deferral_amount": [
        "deferral_amount", "deferred_amount", "401k", "401k_amount", "deferral", "elective_deferral", "ee deferral",
    ],
}
DEPOSIT_ALIASES = {
    "deposit_id": ["deposit_id", "transaction_id", "trace_id", "ref"],
    "deposit_date": ["deposit_date", "post_date", "transaction_date"],
    "deposit_amount": ["deposit_amount", "amount", "credit_amount"],
}
POSTING_ALIASES = {
    "employee_id": ["employee_id", "emp_id", "participant_id"],
    "post_date": ["post_date", "posted_date"],
    "posted_amount": ["posted_amount", "amount"],
}
TRANSACTION_TYPE_NAMES = ["transaction_type", "transaction type", "type", "tran_type", "transaction code"]
BANK_DESCRIPTION_NAMES = [
    "description", "desc", "transaction_description", "transaction description", "memo", "details",
]


def plain(name: str) -> str:
    return str(name).lower().strip()


def squeezed(name: str) -> str:
    """Lower case without spaces, underscores and hyphens."""
    return plain(name).replace(" ", "").replace("_", "").replace("-", "")


def find_column(columns: list[str], names: list[str], form=plain) -> str | None:
    """First accepted name that is present, compared in the given form."""
    present = {form(c): c for c in columns}
    return next((present[form(n)] for n in names if form(n) in present), None)


def alias_map(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Header -> canonical name. One header per canonical name; the best alias wins."""
    taken: set[str] = set()
    chosen: dict[str, str] = {}
    for canonical, names in aliases.items():
        free = [c for c in columns if c not in taken]
        header = find_column(free, [canonical, *names])
        if header is not None:
            chosen[header] = canonical
            taken.add(header)
    return chosen


@dataclass
class TransactionHeaders:
    """Which headers feed the canonical transaction columns."""

    date: str | None = None
    amount: str | None = None
    credit: str | None = None
    debit: str | None = None
    description: str | None = None
    reference: str | None = None
    unused: list[str] = field(default_factory=list)


def resolve_transaction_headers(columns: list[str]) -> TransactionHeaders:
    """Pick headers: exact alias first, then squeezed spelling, then credit minus debit.

    A credit and a debit column side by side are one signed amount, not two candidates.
    """
    chosen = {v: k for k, v in alias_map(columns, TRANSACTION_ALIASES).items()}
    date = chosen.get("txn_date") or find_column(columns, TRANSACTION_ALIASES["txn_date"], squeezed)
    amount = chosen.get("txn_amount") or find_column(columns, AMOUNT_NAMES, squeezed)
    credit, debit = (find_column(columns, names, squeezed) for names in (CREDIT_NAMES, DEBIT_NAMES))
    if amount in (credit, debit) and credit and debit:
        amount = None
    if amount is not None:
        credit = debit = None
    picked = [date, amount, credit, debit, chosen.get("description"), chosen.get("reference")]
    return TransactionHeaders(*picked, [c for c in columns if c not in picked])
