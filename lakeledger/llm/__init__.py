"""Operators that prepare a training corpus.  Nothing outside this subpackage imports it."""
