"""kindred: collaborative-filtering analytics as Spark DataFrame operators."""
