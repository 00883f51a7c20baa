"""The same results in plain SQL, written independently of the Spark plans, for DuckDB."""

from __future__ import annotations

# Code, label, reason, action and severity of every outcome, stated here apart from the engine.
_NONE = "No action required."
_LINK = "Review candidate set and confirm the correct linkage."
OUTCOMES = {
    "missing_in_a": ("missing_in_a", "Missing in System A", "Record appears in other systems but not in System A.",
                     "Request missing export or confirm omission.", "high"),
    "missing_in_b": ("missing_in_b", "Missing in System B", "Record appears in System A but not in System B.",
                     "Request missing export or verify posting.", "high"),
    "missing_in_c": ("missing_in_c", "Missing in System C", "Record appears in Systems A/B but not in System C.",
                     "Request System C export or verify posting.", "high"),
    "duplicate": ("duplicate_candidate", "Duplicate Candidate", "Duplicate records detected within a source system.",
                  "Check for duplicate export or de-duplicate source data.", "low"),
    "many_resolved": ("matched", "Matched", "High confidence match resolved from multiple candidates.", _NONE, "low"),
    "many_probable": ("probable_match", "Probable Match", "Multiple candidates exist; highest confidence match is probable.",
                      "Review and confirm the suggested match.", "medium"),
    "many_ambiguous": ("ambiguous_match", "Ambiguous Match",
                       "Multiple candidates exist on both sides within the matching window.", _LINK, "medium"),
    "one_to_many": ("one_to_many", "One-to-Many", "One record in System A maps to multiple candidates in System B.",
                    "Verify batch grouping or split logic.", "medium"),
    "many_to_one": ("many_to_one", "Many-to-One", "Multiple records in System A could map to a single System B record.",
                    "Verify aggregation or batch posting.", "medium"),
    "amount_mismatch": ("amount_mismatch", "Amount Mismatch", "Amounts are close but not an exact match.",
                        "Validate amounts or identify adjustments.", "high"),
    "partial_probable": ("probable_match", "Probable Match", "Match is likely but amount variance exists.",
                         "Review and confirm the match.", "medium"),
    "partial_weak": ("partial_match_candidate", "Partial Match Candidate", "Amounts are close but confidence is low.",
                     "Review source records and matching rules.", "medium"),
    "exact_matched": ("matched", "Matched", "Amount and date align within tolerance.", _NONE, "low"),
    "exact_probable": ("probable_match", "Probable Match", "Match is likely but reference or timing is weak.",
                       "Review and confirm the match.", "medium"),
    "exact_weak": ("ambiguous_match", "Ambiguous Match", "Exact amount but insufficient supporting signals.", _LINK, "medium"),
}

def _pad(expr: str, width: int) -> str:
    text = f"cast({expr} as varchar)"
    return f"case when length({text}) < {width} then lpad({text}, {width}, '0') else {text} end"


def _up(expr: str, places: int) -> str:
    scale = f"{10 ** places}.0::double"
    return f"(floor(({expr}) * {scale} + 0.5::double) / {scale})"


RANK = "cast(substr(o_orderpriority, 1, 1) as int)"
ORDERS = f"o as (select *, {RANK} as rank, o_orderdate as day, o_totalprice as price from orders)"

SYSTEM_A = f"""{ORDERS}, sa as (
  select day as txn_date, price as txn_amount, o_orderstatus as description, 'ORD-' || o_orderkey as reference,
    'ledger.csv' as source_file, 'ledger.csv:TXN' || {_pad('o_orderkey + 1', 5)} as row_id from o)"""


def _system_b(references: bool) -> str:
    ref = """case when o_orderstatus = 'P' and rank = 4 then null when o_orderstatus = 'O' then 'ORD' || o_orderkey
      else 'ORD-' || o_orderkey end""" if references else "cast(null as varchar)"
    return f"""lines as (
  select *, unnest(case when o_orderstatus = 'P' and rank = 5 then cast([] as varchar[])
    when o_orderstatus = 'F' and rank = 2 then ['settled', 'copy']
    when o_orderstatus = 'O' and rank = 4 then ['settled', 'charge'] else ['settled'] end) as line from o),
sb as (
  select day + to_days(rank - 1) as txn_date,
    case when line = 'charge' then price + 7777.0::double
      when o_orderstatus = 'P' and rank = 3 then {_up('price * 1.05::double', 2)} else price end as txn_amount,
    line as description, {ref} as reference, 'bank.csv' as source_file,
    'bank.csv:TXN' || {_pad('o_orderkey + 1', 5)} || case when line = 'settled' then '' else '-' || line end as row_id
  from lines)"""


GAP = "abs(b.txn_amount - a.txn_amount)"
BASE = "greatest(abs(a.txn_amount), 1e-9::double)"
DAYS = "cast(floor(abs(epoch_us(b.txn_date) - epoch_us(a.txn_date)) / 86400000000) as int)"
NEAR_DATE = "b.txn_date between a.txn_date - interval 3 day and a.txn_date + interval 3 day"
DATE_SCORE = ("(case when days = 0 then 1.0::double when days <= 3 then 0.7::double + 0.3::double * "
              "(1.0::double - days / 3.0::double) else 0.2::double end)")

CANDIDATES = f"""counts_a as (select a.row_id, count(*) as n from sa a join sb b on {NEAR_DATE} and {GAP} / {BASE} <= 0.1::double group by 1),
counts_b as (select b.row_id, count(*) as n from sa a join sb b on {NEAR_DATE} and {GAP} / {BASE} <= 0.1::double group by 1)"""

# Ratio of matching blocks of two unequal texts: the longest common block (earliest in the first text, then in the
# second), and the same again left and right of it. One row per stretch still to compare, one per block found.
RATIOS = """blocks(ra, rb, size, a0, a1, b0, b1) as (
  select ra, rb, 0, 1, length(ra) + 1, 1, length(rb) + 1 from compared
  union all
  select ra, rb, part.size, part.a0, part.a1, part.b0, part.b1 from (
    select ra, rb, unnest([{'size': m.size, 'a0': 0, 'a1': 0, 'b0': 0, 'b1': 0},
      {'size': 0, 'a0': a0, 'a1': -m.i, 'b0': b0, 'b1': -m.j}, {'size': 0, 'a0': m.size - m.i, 'a1': a1, 'b0': m.size - m.j, 'b1': b1}]) as part
    from (select ra, rb, a0, a1, b0, b1, list_max(flatten(list_transform(range(a0, a1), lambda i: list_transform(range(b0, b1), lambda j:
        {'size': len(list_filter(range(1, least(a1 - i, b1 - j) + 1), lambda k: substr(ra, i, k) = substr(rb, j, k))), 'i': -i, 'j': -j})))) as m
      from blocks where size = 0 and a1 > a0 and b1 > b0) where m.size > 0)),
ratios as materialized (select ra, rb, 2.0::double * sum(size) / (length(ra) + length(rb)) as ratio from blocks group by ra, rb)"""


def _similarity(ra: str, rb: str) -> str:
    return (f"(case when coalesce({ra}, '') = '' or coalesce({rb}, '') = '' then 0.5::double when {ra} = {rb} then 1.0::double "
            "else r.ratio end)")


def _ordered(source: str, target: str, number: str) -> str:
    """Rows of a system in matching order, copies next to their first copy."""
    return f"""placed_{target} as (
  select *, min(lpad(cast(length(row_id) as varchar), 4, '0') || row_id) over (
    partition by txn_date, txn_amount, coalesce(reference, '')) as first_copy from {source}),
ordered_{target} as (
  select *, row_number() over (order by txn_date, source_file, first_copy, length(row_id), row_id) as {number} from placed_{target})"""


def _band(target: str, left: str, key: str, right: str, number: str) -> str:
    return f"""{target} as materialized (
  select a.{key}, b.{number}, b.txn_date as txn_date_b, a.reference as ra, b.reference as rb, {GAP} as gap, {BASE} as scale, {DAYS} as days
  from {left} a join {right} b on {NEAR_DATE} and ({GAP} <= 0.01::double or {GAP} / {BASE} <= 0.1::double))"""


def _scored(target: str, band: str, key: str, number: str) -> str:
    return f"""{target} as (
  select {key}, {number}, gap <= 0.01::double as exact, txn_date_b,
    0.55::double * (1.0::double - least(gap / scale, 1.0::double)) + 0.25::double * {DATE_SCORE} + 0.2::double * {_similarity('b.ra', 'b.rb')} as score
  from {band} b left join ratios r on r.ra = b.ra and r.rb = b.rb)"""


def _compared(*bands: str) -> str:
    parts = " union ".join(f"select distinct ra, rb from {b} where ra <> rb and ra <> '' and rb <> ''" for b in bands)
    return f"compared as materialized ({parts})"


ORDERED = f"""ordered_a as (
  select *, row_number() over (order by txn_date, source_file, length(row_id), row_id) as n from sa), {_ordered('sb', 'b', 'p')}"""
PAIRS = f"""{ORDERED}, {_band('band', 'ordered_a', 'n', 'ordered_b', 'p')}, {_compared('band')}, {RATIOS}, {_scored('pairs', 'band', 'n', 'p')}"""

# the third system: system B one day later, without its charge lines
SYSTEM_C = f"""sc as (
  select txn_date + interval 1 day as txn_date, txn_amount, description, reference, 'processor.csv' as source_file,
    'processor' || substr(row_id, 5) as row_id from sb where description <> 'charge'), {_ordered('sc', 'c', 'q')}"""
PAIRS_C = f"""{ORDERED}, {SYSTEM_C}, bases as (
  select 'a' || n as base, txn_date, txn_amount, reference from ordered_a union all select 'b' || p, txn_date, txn_amount, reference from ordered_b),
{_band('band', 'ordered_a', 'n', 'ordered_b', 'p')}, {_band('band_c', 'bases', 'base', 'ordered_c', 'q')},
{_compared('band', 'band_c')}, {RATIOS}, {_scored('pairs', 'band', 'n', 'p')}, {_scored('pairs_c', 'band_c', 'base', 'q')},
thirds as materialized (
  select base, txn_amount as amount_c, source_file as source_c_file, row_id as source_c_row_id from (
    select *, row_number() over (partition by base order by exact desc, score desc, q) as r from pairs_c) join ordered_c using (q) where r = 1)"""
NO_THIRD = """thirds as (select cast(null as varchar) as base, cast(null as double) as amount_c, cast(null as varchar) as source_c_file,
  cast(null as varchar) as source_c_row_id where false)"""

# A rows in order, each taking its best B that is still free; only B rows inside the
# date window of the current row have to be remembered as taken
TAKEN = """wishes as materialized (
  select a.n, coalesce(list(pairs.p order by exact desc, score desc, pairs.p) filter (where pairs.p is not null), []) as wanted,
    coalesce(min(pairs.p), 0) as lowest
  from ordered_a a left join pairs on pairs.n = a.n group by a.n),
later as materialized (select n, wanted, min(case when lowest = 0 then null else lowest end) over (
  order by n rows between current row and unbounded following) as lowest from wishes),
walk(n, p, taken) as (
  select cast(0 as bigint), cast(null as bigint), cast([] as bigint[])
  union all
  select n, p, case when p is null then kept else list_append(kept, p) end from (
    select w.n, list_filter(w.wanted, lambda x: not list_contains(walk.taken, x))[1] as p,
      list_filter(walk.taken, lambda x: x >= coalesce(w.lowest, 0)) as kept
    from walk join later w on w.n = walk.n + 1))"""


def _text(position: int) -> str:
    whens = " ".join(f"when '{k}' then '{row[position]}'" for k, row in OUTCOMES.items())
    return f"case outcome {whens} end"


def _result(with_c: bool) -> str:
    missing_c = "when amount_c is null then 'missing_in_c'" if with_c else ""
    return f"""matches as (select n, p from walk where p is not null),
joined as (
  select a.txn_date as txn_date_a, a.txn_amount as txn_amount_a, a.description as description_a,
    a.reference as reference_a, a.source_file as source_file_a, a.row_id as row_id_a,
    b.txn_date as txn_date_b, b.txn_amount as txn_amount_b, b.description as description_b,
    b.reference as reference_b, b.source_file as source_file_b, b.row_id as row_id_b, coalesce('a' || a.n, 'b' || b.p) as base
  from ordered_a a left join matches m on m.n = a.n full outer join ordered_b b on b.p = m.p),
measured as (
  select joined.*, thirds.* exclude (base), {_similarity('reference_a', 'reference_b')} as ref_sim, row_id_a is not null as present_in_a, row_id_b is not null as present_in_b,
    cast(floor(abs(epoch_us(txn_date_b) - epoch_us(txn_date_a)) / 86400000000) as int) as date_delta_days,
    abs(txn_amount_b - txn_amount_a) as amount_delta,
    coalesce(ca.n, 0) as candidate_count_a, coalesce(cb.n, 0) as candidate_count_b,
    row_id_a in (select row_id from (select row_id, count(*) over (partition by txn_date, txn_amount, coalesce(reference, '')) c from sa) where c > 1) as dup_a,
    row_id_b in (select row_id from (select row_id, count(*) over (partition by txn_date, txn_amount, coalesce(reference, '')) c from sb) where c > 1) as dup_b
  from joined left join counts_a ca on ca.row_id = row_id_a left join counts_b cb on cb.row_id = row_id_b
    left join ratios r on r.ra = reference_a and r.rb = reference_b left join thirds on thirds.base = joined.base),
scored as (
  select *, case when not (present_in_a and present_in_b) then 'Missing' when amount_delta <= 0.01::double then 'Exact' else 'Partial' end as match_status,
    case when present_in_a and present_in_b then {_up('''greatest(0.0::double, least(1.0::double,
      0.5::double * (1.0::double - least(amount_delta / greatest(abs(txn_amount_a), 1e-9::double), 1.0::double))
      + 0.2::double * ''' + DATE_SCORE.replace('days', 'date_delta_days') + ''' + 0.2::double * ref_sim
      + 0.1::double * (case when candidate_count_a <= 1 and candidate_count_b <= 1 then 1.0::double
          when candidate_count_a > 1 and candidate_count_b > 1 then 0.3::double else 0.6::double end)))''', 2)} else 0.0::double end as confidence_score
  from measured),
decided as (
  select *, case when not present_in_a then 'missing_in_a' when not present_in_b then 'missing_in_b' {missing_c}
    when coalesce(dup_a, false) or coalesce(dup_b, false) then 'duplicate'
    when candidate_count_a > 1 and candidate_count_b > 1 then
      case when confidence_score >= 0.85::double then 'many_resolved' when confidence_score >= 0.6::double then 'many_probable' else 'many_ambiguous' end
    when candidate_count_a > 1 then 'one_to_many' when candidate_count_b > 1 then 'many_to_one'
    when match_status = 'Partial' then
      case when confidence_score >= 0.85::double then 'amount_mismatch' when confidence_score >= 0.6::double then 'partial_probable' else 'partial_weak' end
    when ref_sim >= 0.6::double or (coalesce(reference_a, '') = '' and coalesce(reference_b, '') = '') then 'exact_matched'
    when confidence_score >= 0.6::double then 'exact_probable' else 'exact_weak' end as outcome
  from scored),
worded as (select *, {_text(0)} as exception_code from decided),
result as (
  select txn_date_a, txn_amount_a, description_a, reference_a, source_file_a, row_id_a, txn_date_b, txn_amount_b,
    description_b, reference_b, source_file_b, row_id_b, date_delta_days, amount_delta, match_status,
    case match_status when 'Exact' then 'None' when 'Partial' then 'Amount Mismatch' else 'Missing Match' end as exception_type,
    candidate_count_a, candidate_count_b, coalesce(dup_a, false) as duplicate_in_a, coalesce(dup_b, false) as duplicate_in_b,
    present_in_a, present_in_b, amount_c is not null as present_in_c, txn_amount_a as amount_a, txn_amount_b as amount_b,
    amount_c, source_c_file, source_c_row_id,
    exception_code, {_text(1)} as exception_label, {_text(2)} as exception_reason, {_text(3)} as suggested_action,
    confidence_score, {_text(4)} as severity,
    (case {_text(4)} when 'high' then 3 when 'medium' then 2 else 1 end) * 1000000.0::double
      + greatest(coalesce(abs(txn_amount_a), 0.0), coalesce(abs(txn_amount_b), 0.0), coalesce(abs(amount_c), 0.0)) as priority_rank
  from worded)"""

def _whole(references: bool, with_c: bool = False) -> str:
    pairs = PAIRS_C if with_c else f"{PAIRS}, {NO_THIRD}"
    return f"with recursive {SYSTEM_A}, {_system_b(references)}, {CANDIDATES}, {pairs}, {TAKEN}, {_result(with_c)} "


PLAIN = _whole(references=False)

# -- remittance ------------------------------------------------------------------------

PAYROLL = f"""payroll as (
  select cast(o_custkey as varchar) as employee_id, o_orderdate as pay_date, o_totalprice as deferral_amount,
    'payroll_' || o_orderstatus || '.csv' as source_file,
    'payroll_' || o_orderstatus || '.csv:PAY' || {_pad('o_orderkey + 1', 5)} as payroll_row_id from orders)"""

_CENTS = "cast(sum(cast({0} as decimal(18,2))) as double)"

BANK = f"""daily as (select o_orderdate as day, {_CENTS.format('o_totalprice')} as total, isodow(o_orderdate) as wd from orders group by o_orderdate),
bank as (
  select 'D' || date_diff('day', date '1970-01-01', cast(day as date)) as deposit_id,
    day + to_days(cast([1, 2, 2, 9, 0, 2, 1][wd] as int)) as deposit_date,
    {_up('total * (case wd when 3 then 0.96::double when 6 then 1.12::double else 1.0::double end)', 2)} as deposit_amount,
    'ACH CREDIT' as transaction_type, 'Employee deferral deposit ' || strftime(day, '%Y%m%d') as description,
    'bank.csv' as source_file, 'bank.csv:DEP' || {_pad("date_diff('day', date '1970-01-01', cast(day as date))", 5)} as deposit_row_id
  from daily where wd <> 5
  union all
  select 'E' || event_id, ts, case when event_type = 'purchase' then -value else value end,
    case event_type when 'view' then 'INTEREST CREDIT' when 'click' then 'ACH DEBIT' when 'error' then 'REVERSAL'
      when 'purchase' then 'ACH DEBIT' when 'signup' then 'DEPOSIT' end,
    case event_type when 'view' then 'Monthly interest income' when 'click' then 'Wire transfer fee'
      when 'error' then 'Reversal of entry' when 'purchase' then 'Card settlement' when 'signup' then 'Counter deposit' end,
    'bank_lines.csv', 'bank_lines.csv:DEP' || {_pad('event_id + 1', 5)} from events),
judged as (
  select *, [k for k in ['FEE', 'INTEREST', 'REVERSAL', 'RETURN', 'NSF', 'ADJUSTMENT'] if contains(upper(coalesce(description, '')), k)] as hits,
    coalesce(transaction_type in ('CREDIT', 'ACH CREDIT', 'DEPOSIT'), false)
      or len([k for k in ['PAYROLL', '401K', '401(K)', 'DEFERRAL', 'CONTRIBUTION'] if contains(upper(coalesce(description, '')), k)]) > 0
      or deposit_amount > 0 as wanted from bank),
deposits as (select deposit_id, deposit_date, deposit_amount, source_file, deposit_row_id from judged where len(hits) = 0 and wanted),
noise as (
  select *, case when len(hits) > 0 then 'Excluded: description contains ' || array_to_string(hits, ', ')
    when not wanted then 'Excluded: not a contribution deposit' else 'Excluded: filtered by rule' end as exclusion_reason
  from judged where len(hits) > 0 or not wanted)"""

TOTALS = f"""totals as (
  select pay_date, {_CENTS.format('deferral_amount')} as payroll_total, count(*) as payroll_rows,
    array_to_string(list_sort(list(distinct source_file)), ', ') as payroll_source_files,
    array_to_string(list(payroll_row_id order by source_file, length(payroll_row_id), payroll_row_id), ', ') as payroll_component_ids
  from payroll group by pay_date)"""

# Monday-to-Friday days numbered through a calendar table
CALENDAR = """calendar as (
  select d, sum(case when isodow(d) < 6 then 1 else 0 end) over (order by d) - case when isodow(d) < 6 then 1 else 0 end as before
  from (select cast(unnest(generate_series(date '1994-12-01', date '2026-12-31', interval 1 day)) as date) as d))"""


def _bdays(start: str, end: str) -> str:
    return f"cast(greatest({end}.before - {start}.before, 0) as int)"


SCHEDULE = f"""{PAYROLL}, {BANK}, {TOTALS}, {CALENDAR},
chosen as (
  select pay_date, arg_min(deposit_row_id, k) as deposit_row_id from (
    select t.pay_date, d.deposit_row_id,
      {{'gap': abs(d.deposit_amount - t.payroll_total), 'd': d.deposit_date, 'f': d.source_file, 'l': length(d.deposit_row_id), 'r': d.deposit_row_id}} as k
    from totals t join deposits d on d.deposit_date >= t.pay_date) group by pay_date),
laid as (
  select t.*, d.deposit_date, d.deposit_amount, d.deposit_row_id,
    (select array_to_string(list_sort(list(distinct e.source_file)), ', ') from deposits e
      where e.deposit_date = d.deposit_date and e.deposit_amount = d.deposit_amount) as deposit_source_files,
    case when d.deposit_date is null then null else {_bdays('c1', 'c2')} end as days_to_deposit
  from totals t left join chosen c on c.pay_date = t.pay_date left join deposits d on d.deposit_row_id = c.deposit_row_id
    left join calendar c1 on c1.d = cast(t.pay_date as date) left join calendar c2 on c2.d = cast(d.deposit_date as date)),
rated as (
  select *, {_up('payroll_total', 2)} as total, case when deposit_amount <> 0 then {_up('deposit_amount', 2)} end as deposit_total,
    abs(payroll_total - deposit_amount) as gap,
    case when deposit_amount is null or payroll_total = 0 then 'Missing' when abs(payroll_total - deposit_amount) <= 0.01::double then 'Exact'
      when abs(payroll_total - deposit_amount) / abs(payroll_total) <= 0.1::double then 'Partial' else 'Missing' end as match_status,
    case when days_to_deposit > 3 then 'Yes' when days_to_deposit <= 3 then 'No' end as late_flag from laid),
typed as (
  select *, case match_status when 'Exact' then 1.0::double when 'Partial' then 1.0::double - gap / abs(payroll_total) / 0.1::double else 0.0::double end as confidence,
    case when match_status = 'Missing' then 'Missing Deposit' when match_status = 'Partial' then 'Amount Mismatch'
      when late_flag = 'Yes' then 'Late Deposit' else 'None' end as exception_type from rated),
amounts as (
  select *, case when match_status <> 'Exact' then {_up('greatest(total - coalesce(deposit_total, 0), 0)', 2)} end as unmatched_payroll_amount,
    case when match_status <> 'Exact' and deposit_total is not null then {_up('greatest(deposit_total - total, 0)', 2)} end as unmatched_deposit_amount
  from typed),
risk as (
  select *, case when exception_type in ('Missing Deposit', 'Late Deposit') then total when exception_type = 'Amount Mismatch' then unmatched_payroll_amount end as principal_at_risk,
    greatest(coalesce(days_to_deposit, 0) - 3, 0) as days_over from amounts),
schedule as (
  select pay_date, total as payroll_total, deposit_total, deposit_date as matched_deposit_date, days_to_deposit, match_status,
    {_up('confidence', 3)} as match_confidence, late_flag, exception_type,
    case when exception_type = 'None' then 'NO' else 'YES' end as review_required,
    case exception_type when 'None' then 'No exception' when 'Late Deposit' then 'Late deposit' when 'Amount Mismatch' then 'Partial deposit' else 'Missing deposit' end as review_reason,
    case exception_type when 'None' then 'NONE' when 'Late Deposit' then 'HIGH' else 'CRITICAL' end as severity,
    case exception_type when 'None' then 'No action' when 'Late Deposit' then 'Calculate lost earnings' else 'Request deposit proof' end as recommended_action,
    payroll_source_files, deposit_source_files, payroll_component_ids, deposit_row_id as deposit_component_ids,
    unmatched_payroll_amount, unmatched_deposit_amount, principal_at_risk,
    case when exception_type <> 'None' then days_over end as days_late_adjusted,
    case when exception_type <> 'None' then 0.05::double end as assumed_annual_rate,
    case when exception_type <> 'None' then {_up('principal_at_risk * 0.05::double / 365.0::double * days_over', 2)} end as lost_earnings_estimate
  from risk)"""

SIMPLE = f"""simple as (
  select pay_date, total as payroll_total, deposit_date as matched_deposit_date, deposit_total as matched_deposit_amount, days_to_deposit,
    case when gap <= 0.01::double then 'Matched' when gap <= payroll_total * 0.1::double then 'Partial' else 'Missing' end as match_status,
    coalesce(late_flag, 'No') as late_flag from rated),
simple_log as (
  select strftime(pay_date, '%Y-%m-%d') as pay_date, payroll_total, coalesce(strftime(matched_deposit_date, '%Y-%m-%d'), '') as matched_deposit_date,
    matched_deposit_amount, {_up('payroll_total - coalesce(matched_deposit_amount, 0)', 2)} as variance, match_status, days_to_deposit, late_flag
  from simple where match_status in ('Partial', 'Missing'))"""

DAY = "strftime(pay_date, '%Y-%m-%d')"
VARIANCE = _up("payroll_total - coalesce(deposit_total, 0)", 2)
POSTINGS = """postings as (
  select cast(o_custkey as varchar) as employee_id, o_orderdate as post_date, o_totalprice as posted_amount from (
    select *, unnest(range(case when o_orderstatus = 'P' and o_orderpriority[1] = '5' then 0
      when o_orderstatus = 'F' and o_orderpriority[1] = '1' then 2 else 1 end)) from orders))"""

THREE_WAY = f"""months as (
  select period_start, {", ".join(f"cast(sum(cast(case when s = '{s}' then amount end as decimal(18,2))) as double) as {s}" for s in ("Payroll", "Trust", "Recordkeeper"))}
  from (select cast(date_trunc('month', pay_date) as date) as period_start, 'Payroll' as s, deferral_amount as amount from payroll
    union all select cast(date_trunc('month', deposit_date) as date), 'Trust', deposit_amount from deposits
    union all select cast(date_trunc('month', post_date) as date), 'Recordkeeper', posted_amount from postings) group by 1),
compared as (
  {" union all ".join(f"select period_start, '{s} to {t}' as reconciliation_type, '{s}' as source_system, coalesce({s}, 0) as source_amount, '{t}' as target_system, coalesce({t}, 0) as target_amount from months" for s, t in (("Payroll", "Trust"), ("Trust", "Recordkeeper"), ("Payroll", "Recordkeeper")))}),
three_way as (
  select *, {_up('source_amount - target_amount', 2)} as variance,
    case when source_amount <> 0 then {_up(_up('source_amount - target_amount', 2) + ' / source_amount * 100', 2)} end as variance_percent,
    case when abs({_up('source_amount - target_amount', 2)}) <= 0.01::double then 'Reconciled' else 'Variance' end as reconciled_status from compared)"""


def _digits(expr: str) -> str:
    return f"coalesce(regexp_replace(cast(cast({expr} as decimal(20,2)) as varchar), '0$', ''), 'None')"


def _best_match(references: bool) -> str:
    return f"""with recursive {SYSTEM_A}, {_system_b(references)}, {PAIRS},
ranked as (select *, row_number() over (partition by n order by exact desc, score desc, p) as r from pairs)
select a.row_id as row_id_a, b.row_id as row_id_b, exact, score from ranked join ordered_a a using (n) join ordered_b b using (p) where r = 1"""


SHAPES = {1: "%Y-%m-%d", 2: "%m/%d/%Y", 3: "%d-%b-%Y", 4: "%Y/%m/%d", 5: "%b %-d %Y"}
EXPORT_LINES = f"""{ORDERS}, numbered as (select *, row_number() over (partition by o_orderstatus order by o_orderkey) as line from o)"""


MONEY = "cast(cast(price as decimal(18,2)) as varchar)"
RAW_TOTAL = f"""case when o_orderstatus = 'P' and rank = 5 then 'n/a' when o_orderstatus = 'F' then '$' || format('{{:,.2f}}', price)
    else {MONEY} end"""
# what the scans of the two written exports find
SCANNED = """select 'Posted Date, Total, Memo, Ref' as columns, 'Posted Date' as date_header, 'Total' as amount_header, 'Memo' as description_header,
    'Ref' as reference_header, count(*) as rows, count(*) filter (where o_orderstatus = 'P' and o_orderpriority[1] = '5') as rows_removed from orders
  union all select 'Value-Date, Credit, Debit, Trace', 'Value-Date', 'Credit - Debit', null, 'Trace', count(*), 0 from orders"""


def _schedule(select: str) -> str:
    return f"with {SCHEDULE} {select}"


ORACLE: dict[str, str] = {
    "normalize_orders": f"""with {EXPORT_LINES} select day as txn_date, price as txn_amount, o_orderstatus as description,
  'ORD-' || o_orderkey as reference, 'export_' || o_orderstatus || '.csv' as source_file,
  'export_' || o_orderstatus || '.csv:TXN' || {_pad('line', 5)} as row_id from numbered where not (o_orderstatus = 'P' and rank = 5)""",
    "quarantine": f"""with {ORDERS} select 'ORD-' || o_orderkey as reference, 'n/a' as raw_amount, 'unparseable amount' as quarantine_reason
  from o where o_orderstatus = 'P' and rank = 5""",
    "credit_minus_debit": f"""with {ORDERS} select day as txn_date, case when o_orderstatus = 'F' then 0.0::double - price else price end as txn_amount,
  cast(null as varchar) as description, 'ORD-' || o_orderkey as reference, 'signed.csv' as source_file,
  'signed.csv:TXN' || {_pad('o_orderkey + 1', 5)} as row_id from o""",
    # the checked folder of shared tables, as the query lists it
    "file_inventory": """select parse_filename(filename) as filename, sha256(content) as sha256, size as file_size_bytes
  from read_blob('/root/testdata/sf0.01/*.parquet')""",
    "row_numbers": """select 'lines_' || l_returnflag as source_file, l_orderkey, l_linenumber,
  row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber) as row_number from lineitem""",
    "candidate_counts": f"""with {SYSTEM_A}, {_system_b(True)}, {CANDIDATES}
select 'A' as system, sa.row_id, coalesce(n, 0) as candidate_count from sa left join counts_a using (row_id)
union all select 'B', sb.row_id, coalesce(n, 0) from sb left join counts_b using (row_id)""",
    "duplicates": f"""with {ORDERS}, {_system_b(True)} select row_id,
  count(*) over (partition by txn_date, txn_amount, coalesce(reference, '')) > 1 as duplicate from sb""",
    "best_match": _best_match(references=False),
    "best_match_referenced": _best_match(references=True),
    "exclusive_match": f"""with recursive {SYSTEM_A}, {_system_b(False)}, {PAIRS}, {TAKEN}
select a.row_id as row_id_a, b.row_id as row_id_b from walk join ordered_a a using (n) join ordered_b b on b.p = walk.p""",
    "reconcile_plain": PLAIN + "select * from result",
    "reconcile_ab": _whole(references=True) + "select * from result",
    "reconcile_abc": _whole(references=True, with_c=True) + "select * from result",
    "matched": PLAIN + "select * from result where exception_code = 'matched'",
    "probable": PLAIN + "select * from result where exception_code = 'probable_match'",
    "exceptions": PLAIN + "select * from result where exception_code <> 'matched'",
    "exception_summary": PLAIN + "select exception_code, count(*) as count from result group by 1",
    "run_stats": PLAIN + f"""select *, {_up('total_system_a - total_system_b', 2)} as variance from (
  select count(*) as rows, {_CENTS.format('amount_a')} as total_system_a, {_CENTS.format('amount_b')} as total_system_b,
    count(*) filter (where exception_code = 'matched') as matched_exact, count(*) filter (where exception_code = 'probable_match') as matched_fuzzy,
    count(*) filter (where exception_code = 'missing_in_a') as unmatched_a, count(*) filter (where exception_code = 'missing_in_b') as unmatched_b,
    count(*) filter (where exception_code <> 'matched') as exception_count from result)""",
    "top_exceptions": PLAIN + """select coalesce(txn_date_a, txn_date_b) as txn_date, amount_a, amount_b, amount_c, exception_label, exception_code,
  confidence_score, severity, date_delta_days, present_in_c, priority_rank from result where exception_code <> 'matched'
  order by priority_rank desc, row_id_a nulls first, row_id_b nulls first limit 10""",
    "ref_similarity": """select o_orderkey, 2.0::double * (length('ORD-' || o_orderkey) - 1) / (2 * length('ORD-' || o_orderkey) - 1) as similarity from orders""",
    "matched_ab": _whole(references=True) + "select * from result where exception_code = 'matched'",
    "case_manifest": PLAIN + f"""select 'case' as case_id, '0.1.0' as engine_version, f.*, 'Date-window matching with amount/reference confidence scoring.' as matching_logic,
  'Normalize headers; Detect date/amount/reference/description; Standardize to canonical fields' as steps, 'some amounts could not be read' as warnings,
  'Systems are peer exports with independent timing.' as assumptions, 'complete' as status, cast(null as varchar) as error,
  3 as date_window_days, 0.01::double as amount_tolerance, 0.1::double as partial_tolerance, m.columns, m.date_header, m.amount_header, m.rows, m.rows_removed, stats.*, true as has_outputs
from (select parse_filename(filename) as filename, sha256(content) as sha256, size as file_size_bytes from read_blob('/root/testdata/sf0.01/orders.parquet')) f,
  ({SCANNED}) m, (select {_CENTS.format('amount_a')} as total_system_a, {_CENTS.format('amount_b')} as total_system_b,
    count(*) filter (where exception_code = 'matched') as matched_exact, count(*) filter (where exception_code = 'probable_match') as matched_fuzzy,
    count(*) filter (where exception_code = 'missing_in_a') as unmatched_a, count(*) filter (where exception_code = 'missing_in_b') as unmatched_b,
    count(*) filter (where exception_code <> 'matched') as exception_count from result) stats""",
    "exports_read": f"""with {ORDERS} select {RAW_TOTAL} as "Total", o_orderstatus || chr(10) || 'says "ORD-' || o_orderkey || '", twice' as note,
  'ORD-' || o_orderkey as "Ref", null as value_date, null as "Credit", null as "Debit", null as "Trace" from o
union all select null, null, null, strftime(day, '%Y-%m-%d'), case when o_orderstatus <> 'F' then {MONEY} end,
  case when o_orderstatus = 'F' then {MONEY} end, 'ORD-' || o_orderkey from o""",
    "exports_loaded": f"""with {ORDERS} select day as txn_date, price as txn_amount, o_orderstatus || chr(10) || 'says "ORD-' || o_orderkey || '", twice' as description,
  'ORD-' || o_orderkey as reference from o where not (o_orderstatus = 'P' and rank = 5)
union all select day, case when o_orderstatus = 'F' then 0.0::double - price else price end, null, 'ORD-' || o_orderkey from o""",
    "exports_set_aside": f"""with {ORDERS} select 'ORD-' || o_orderkey as reference, o_orderstatus || chr(10) || 'says "ORD-' || o_orderkey || '", twice' as description,
  'n/a' as raw_amount, 'unparseable amount' as quarantine_reason from o where o_orderstatus = 'P' and rank = 5""",
    "export_reports": f"""with {ORDERS} select 'a' as system, columns, date_header, amount_header, description_header, reference_header, rows, rows_removed
  from ({SCANNED})""",
    "data_quality": f"""with {ORDERS}, raw as (select *, 'export_' || o_orderstatus || '.csv' as source_file, 'ORD-' || o_orderkey as reference,
    o_orderstatus = 'P' and rank = 1 as no_date, o_orderstatus = 'P' and rank = 2 as blank, o_orderstatus = 'P' and rank = 5 as no_amount from o)
select case when blank then 'missing date' else 'unparseable date' end as issue, source_file, reference, {RAW_TOTAL} as raw_amount,
  cast(null as bigint) as copies from raw where no_date or blank
union all select 'unparseable amount', source_file, reference, 'n/a', null from raw where no_amount
union all select 'duplicate record', source_file, reference, null, 2 from raw where o_orderstatus = 'F' and rank = 2""",
    "run_metadata": """select 'run-1' as run_id, '2025-01-15T00:00:00Z' as run_timestamp_utc, '0.1.0' as engine_version,
  parse_filename(filename) as filename, sha256(content) as sha256, 3 as date_window_days, 0.01::double as amount_tolerance
  from read_blob('/root/testdata/sf0.01/orders.parquet')""",
    "case_files": _schedule(f"""select {DAY} as pay_date, payroll_total, deposit_total, strftime(matched_deposit_date, '%Y-%m-%d') as matched_deposit_date,
  days_to_deposit, match_status, late_flag, exception_type, severity from schedule"""),
    "instant_counts": """with a as (select * from events where event_type = 'purchase'), b as (select * from events where event_type <> 'purchase'),
p as (select a.event_id as x, b.event_id as y from a join b on b.ts between a.ts - interval 1 day and a.ts + interval 1 day
  and abs(b.value - a.value) / greatest(abs(a.value), 1e-9::double) <= 0.1::double)
select event_id, event_type, coalesce(n, 0) as candidate_count from events left join (
  select x as event_id, count(*) as n from p group by x union all select y, count(*) from p group by y) using (event_id)""",
    "instant_deposits": """with a as (select ts as pay_date, max(value) as total from events where event_type = 'purchase' group by ts),
c as (select pay_date, arg_min(event_id, {'gap': abs(b.value - a.total), 'd': b.ts, 'l': length('E' || event_id), 'r': 'E' || event_id}) as event_id
  from a join events b on b.ts >= a.pay_date and b.event_type <> 'purchase' group by pay_date)
select pay_date, value as deposit_amount, ts as deposit_date, 'E' || event_id as deposit_row_id from c join events using (event_id)""",
    # the added character leaves two equal halves; frequent characters only lengthen a block, from the beginning or around the rare one
    "long_ref_similarity": """select o_orderkey, case o_orderkey % 3 when 0 then 256.0::double / 257 when 1 then 240.0::double / 481
  else 410.0::double / 458 end as similarity from orders""",
    "business_days": f"""with {CALENDAR} select l_orderkey, l_linenumber, {_bdays('c1', 'c2')} as business_days, {_bdays('c1', 'c2')} > 3 as late
  from lineitem join orders on l_orderkey = o_orderkey join calendar c1 on c1.d = cast(o_orderdate as date) join calendar c2 on c2.d = cast(l_shipdate as date)""",
    "payroll_totals": f"with {PAYROLL}, {TOTALS} select pay_date, payroll_total, payroll_rows, payroll_source_files from totals",
    "component_ids": f"with {PAYROLL}, {TOTALS} select pay_date, payroll_component_ids from totals",
    "deposits_kept": f"with {BANK} select * from deposits",
    "noise_log": f"""with {BANK} select deposit_id, deposit_date, deposit_amount, transaction_type, description, source_file, deposit_row_id, exclusion_reason from noise""",
    "kept_excluded": f"""with {BANK} select source_file, count(*) filter (where len(hits) = 0 and wanted) as rows_kept,
  count(*) filter (where not (len(hits) = 0 and wanted)) as rows_excluded from judged group by 1""",
    "remittance_schedule": _schedule(f"""select {DAY} as pay_date, coalesce(strftime(matched_deposit_date, '%Y-%m-%d'), '') as matched_deposit_date,
  * exclude (pay_date, matched_deposit_date) from schedule"""),
    "review_fields_v1": _schedule(f"""select pay_date, {_up('confidence', 3)} as match_confidence, late_flag, exception_type,
  case when confidence < 0.9::double or exception_type <> 'None' then 'YES' else 'NO' end as review_required,
  array_to_string(list_filter([case when confidence < 0.9::double then 'Low confidence match' end, case when late_flag = 'Yes' then 'Late deposit' end,
    case when contains(exception_type, 'Mismatch') then 'Amount mismatch' end, case when coalesce(deposit_total, 0) = 0 then 'Missing deposit' end],
    lambda x: x is not null), ', ') as review_reason from typed"""),
    "simple_schedule": f"with {SCHEDULE}, {SIMPLE} select * from simple",
    "simple_exception_log": f"with {SCHEDULE}, {SIMPLE} select * from simple_log",
    "simple_status_counts": f"""with {SCHEDULE}, {SIMPLE} select count(*) filter (where match_status = 'Missing') as missing,
  count(*) filter (where match_status = 'Partial') as partial, count(*) filter (where late_flag = 'Yes') as late from simple_log""",
    "required_deposit_dates": _schedule(f""", due as (
  select s.pay_date, s.matched_deposit_date, min(c.d) as required_deposit_date from schedule s join calendar c0 on c0.d = cast(s.pay_date as date)
    join calendar c on isodow(c.d) < 6 and c.d > c0.d - 3 and c.d < c0.d + 14
      and c.before = c0.before - (case when isodow(c0.d) < 6 then 0 else 1 end) + 7 group by 1, 2)
select pay_date, matched_deposit_date, required_deposit_date, case when matched_deposit_date is not null then {_bdays('c1', 'c2')} end as days_past_required
from due join calendar c1 on c1.d = required_deposit_date left join calendar c2 on c2.d = cast(matched_deposit_date as date)"""),
    "timeliness_report": _schedule(f"""select {DAY} as pay_date, payroll_total, strftime(matched_deposit_date, '%Y-%m-%d') as deposit_date,
  days_to_deposit, 3 as threshold_days, days_to_deposit - 3 as days_over_threshold, exception_type from schedule where late_flag = 'Yes'"""),
    "exception_log": _schedule(f"""select {DAY} as pay_date, payroll_total, deposit_total, {VARIANCE} as variance, match_status, days_to_deposit, late_flag,
  exception_type, payroll_source_files, deposit_source_files, review_required, review_reason, severity, recommended_action, principal_at_risk,
  days_late_adjusted, assumed_annual_rate, lost_earnings_estimate from schedule where exception_type <> 'None'"""),
    "audit_workpaper": _schedule(f"""select {DAY} as pay_date, exception_type, late_flag, days_to_deposit, payroll_total, deposit_total, {VARIANCE} as variance,
  payroll_component_ids, deposit_component_ids, payroll_source_files, deposit_source_files, review_reason, severity, recommended_action
  from schedule where exception_type <> 'None'"""),
    "correction_packet_index": _schedule(f"""select 'CP-' || {_pad('row_number() over (order by schedule.pay_date)', 4)} as case_id, {DAY} as pay_date, exception_type, severity, principal_at_risk,
  days_late_adjusted, lost_earnings_estimate,
  case exception_type when 'Amount Mismatch' then 'Policy: Deposits should be completed in full; partial deposits require correction and restoration.'
    else 'Policy: Missing deposits require correction and documentation.' end as regulatory_basis, 'Yes' as correction_required,
  case exception_type when 'Amount Mismatch' then 'Source register, deposit detail, reconciliation worksheet'
    else 'Source register, deposit statement, deposit confirmation or proof of correction' end as documents_needed,
  'Process Owner' as next_action_owner, '2025-01-15' as generated_on from schedule where severity = 'CRITICAL'"""),
    "case_summary": _schedule(f"""select *, {_up('total_payroll - total_deposited', 2)} as variance from (
  select count(*) as pay_periods, count(*) filter (where exception_type <> 'None') as exceptions, count(*) filter (where late_flag = 'Yes') as late_deposits,
    {_CENTS.format('payroll_total')} as total_payroll, {_CENTS.format('deposit_total')} as total_deposited from schedule)"""),
    "trace_summaries": _schedule(f"""select {DAY} as case_date, concat_ws(chr(10), 'Pay date: ' || {DAY}, 'Payroll total: ' || {_digits('payroll_total')},
  'Deposit total: ' || {_digits('deposit_total')}, 'Variance: ' || {_digits(VARIANCE)}, 'Exception type: ' || exception_type, 'Severity: ' || severity,
  'Days late: ' || case when late_flag = 'Yes' then days_to_deposit else 0 end, 'Recommended action: ' || recommended_action,
  'Payroll source files: ' || coalesce(payroll_source_files, 'None'), 'Deposit source files: ' || coalesce(deposit_source_files, 'None')) as summary
  from schedule where review_required = 'YES'"""),
    "trace_payroll": _schedule("""select strftime(p.pay_date, '%Y-%m-%d') as case_date, employee_id, deferral_amount, payroll_row_id
  from payroll p join schedule s on s.pay_date = p.pay_date where review_required = 'YES'"""),
    "trace_deposits": _schedule(f"""select {DAY} as case_date, d.deposit_id, d.deposit_date, d.deposit_amount, d.source_file, d.deposit_row_id
  from schedule join deposits d on d.deposit_row_id = deposit_component_ids where review_required = 'YES'"""),
    "evidence_index": _schedule(f""", documents as (
  select 1 as section, 'PAY' as prefix, source_file as document_name, 'Payroll Export' as document_type, 'Payroll System' as source,
    min(pay_date) as lo, max(pay_date) as hi, count(*) as record_count, {_CENTS.format('deferral_amount')} as total_amount,
    'Primary source for contribution calculations' as relevance from payroll group by source_file
  union all select 2, 'DEP', source_file, 'Bank/Trust Statement', 'Bank/Custodian', min(deposit_date), max(deposit_date), count(*),
    {_CENTS.format('deposit_amount')}, 'Verification of deposit timing and amounts' from deposits group by source_file
  union all select 3, 'REM', 'remittance_schedule.csv', 'Reconciliation Report', 'Remittance Engine', min(pay_date), max(pay_date), count(*),
    {_CENTS.format('payroll_total')}, 'Reconciliation of payroll to deposits' from schedule)
select prefix || '-' || {_pad('row_number() over (order by section, document_name)', 3)} as evidence_id, document_name, document_type, source,
  strftime(lo, '%Y-%m-%d') || ' to ' || strftime(hi, '%Y-%m-%d') as date_range, record_count, total_amount,
  case when section = 2 then record_count end as rows_kept,
  case when section = 2 then (select count(*) from noise where noise.source_file = document_name) end as rows_excluded,
  relevance, '2025-01-15' as date_created from documents"""),
    "posting_exceptions": f"""with {PAYROLL}, {POSTINGS},
paid as (select employee_id, cast(date_trunc('month', pay_date) as date) as period, {_CENTS.format('deferral_amount')} as payroll_amount, count(*) as payroll_rows from payroll group by 1, 2),
posted as (select employee_id, cast(date_trunc('month', post_date) as date) as period, {_CENTS.format('posted_amount')} as posted_amount, count(*) as posting_rows from postings group by 1, 2),
both_sides as (select *, {_up('coalesce(payroll_amount, 0) - coalesce(posted_amount, 0)', 2)} as variance,
  case when posting_rows is null then 'Missing Posting' when payroll_rows is null then 'Unexpected Posting' when posting_rows > payroll_rows then 'Duplicate Posting'
    when abs(coalesce(payroll_amount, 0) - coalesce(posted_amount, 0)) > 0.01::double then 'Amount Difference' end as finding
  from paid full outer join posted using (employee_id, period))
select employee_id, period, payroll_amount, posted_amount, payroll_rows, posting_rows, variance, finding from both_sides where finding is not null""",
    "three_way_schedule": f"with {PAYROLL}, {BANK}, {POSTINGS}, {THREE_WAY} select * from three_way",
    "validation_failures": f"""with {SCHEDULE}, {POSTINGS}, {THREE_WAY}
select 'V001' as rule_id, period_start || ' ' || reconciliation_type as subject, variance as amount from three_way where reconciled_status = 'Variance'
union all select 'V002', {DAY}, cast(days_to_deposit as double) from schedule where days_to_deposit > 3
union all select 'V003', coalesce(p.employee_id, q.employee_id), case when q.employee_id is null then 1.0 else -1.0 end
  from (select distinct employee_id from payroll) p full outer join (select distinct employee_id from postings) q using (employee_id) where p.employee_id is null or q.employee_id is null
union all select 'V004', employee_id || ' ' || y, total from (
  select employee_id, year(pay_date) as y, {_CENTS.format('deferral_amount')} as total from payroll group by 1, 2) where total > 500000""",
}
