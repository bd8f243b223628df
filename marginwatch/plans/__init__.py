"""Whole analyses composed from operators, and the query registry."""
