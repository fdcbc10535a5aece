"""Column expressions and small per-batch kernels."""
