"""Reduce, compare and explain wide event records (network flows) on Spark."""
