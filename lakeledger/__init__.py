"""Catalog reconciliation and corpus preparation as PySpark DataFrame operators."""
