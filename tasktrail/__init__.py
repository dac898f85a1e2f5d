"""School progress reporting as composable Spark DataFrame operators."""
