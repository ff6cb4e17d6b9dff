"""Column expressions: each takes and returns Spark Columns, nothing runs in Python."""
