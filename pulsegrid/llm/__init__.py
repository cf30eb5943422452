"""Operators for preparing training text: search, scoring, redaction, duplicate removal, archives, tokens."""
