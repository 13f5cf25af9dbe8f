"""Operators that prepare training data: one module per operator, queries in `queries`."""
