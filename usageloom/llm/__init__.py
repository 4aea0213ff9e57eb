"""Operators that prepare training text, and the queries that apply them."""
