"""Operators for preparing training text at corpus scale, and the queries that apply them."""
