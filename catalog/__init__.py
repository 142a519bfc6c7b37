"""Registered queries with their SQL equivalents."""
