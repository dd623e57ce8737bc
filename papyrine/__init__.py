"""Document processing as Spark DataFrame operators."""
