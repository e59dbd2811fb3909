"""Column expressions and argument guards shared by the operators."""
