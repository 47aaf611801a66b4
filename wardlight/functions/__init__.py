"""Column helpers shared by the operators; all are native Spark expressions."""
