"""Operators of the triple-inference library."""
