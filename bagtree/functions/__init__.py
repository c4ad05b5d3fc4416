"""Column expressions and the Arrow kernels used by the operators."""
