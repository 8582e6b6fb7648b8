"""Scalar text functions and the language dimension."""
