"""Column helpers; every one is a native Spark expression."""
