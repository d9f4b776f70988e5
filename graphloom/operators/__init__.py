"""Operators on triples and solutions."""
