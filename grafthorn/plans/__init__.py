"""Plans of the triple-inference library."""
