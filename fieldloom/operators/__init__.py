"""Relational operators, usable on any table."""
