"""Functions of the triple-inference library."""
