"""Variance models: numpy kernels that fit one series, and their fan-out over groups of a table."""
