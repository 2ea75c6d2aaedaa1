"""Security-operations data jobs as plain Spark DataFrame functions."""
