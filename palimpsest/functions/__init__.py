"""Column functions; all are built of built-in expressions."""
