"""Point-in-time filing analytics as Spark DataFrame operators."""
