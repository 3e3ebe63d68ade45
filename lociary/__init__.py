"""Fine-mapping analytics as Spark DataFrame operators."""
