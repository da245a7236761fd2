"""Clinical concept analytics as Spark DataFrame operators."""
