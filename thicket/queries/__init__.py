"""Queries of the operators, with SQL where it can express them."""
