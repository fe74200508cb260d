"""Sequence-read analytics and tabular experiment statistics as PySpark DataFrame operators."""
