"""Column functions: text scalars of the metrics."""
