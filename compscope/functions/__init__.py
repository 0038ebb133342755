"""Column expressions; everything here is a plain Spark SQL expression unless stated."""
