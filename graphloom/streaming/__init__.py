"""Triples as streams."""
