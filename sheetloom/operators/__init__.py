"""Table-level operators, each ``DataFrame -> DataFrame``."""
