"""Fleet stream analytics as Spark DataFrame functions."""
