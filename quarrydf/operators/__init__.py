"""Relational operators of the table engine."""
