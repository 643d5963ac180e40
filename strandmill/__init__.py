"""Text, decision and evaluation analytics expressed as Spark DataFrame operators."""
