"""Sources of the triple-inference library."""
