"""Streaming of the triple-inference library."""
