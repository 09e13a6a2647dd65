"""Construction knowledge, pricing, review and geometry analytics as Spark DataFrame operators."""
