"""Whole programs: the context engine and the contract queries."""
