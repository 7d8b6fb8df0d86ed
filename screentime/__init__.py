"""On-screen brand exposure analytics as Spark DataFrame operators."""
