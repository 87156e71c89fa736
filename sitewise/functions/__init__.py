"""Column -> Column building blocks (built-in Spark expressions only)."""
