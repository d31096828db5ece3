"""A batch analytics engine for layered data platforms, on DataFrames and SQL alone."""
