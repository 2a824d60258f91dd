"""Code-intelligence analytics expressed as Spark DataFrame operators."""
