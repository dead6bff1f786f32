"""Scalar functions as Column expressions; Python runs only where a name says so."""
