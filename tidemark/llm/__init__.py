"""Operators for preparing training text, their queries, and nothing the rest of the library needs."""
