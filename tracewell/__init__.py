"""Tracewell: evidence-graph analytics as PySpark DataFrame operators."""
