"""Relational operators over records, messages, runs and corpora."""
