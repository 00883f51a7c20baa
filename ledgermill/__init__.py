"""Spark-native reconciliation: match exports between systems, grade exceptions, write audit reports."""

__version__ = "0.1.0"
