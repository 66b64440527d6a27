"""Column expressions and the few Python functions that Spark's own can't replace."""
