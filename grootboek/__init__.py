"""Grootboek: ledger analytics as Spark DataFrame jobs."""
