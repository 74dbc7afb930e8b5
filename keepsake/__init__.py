"""Analytics over personal data exports, written as Spark DataFrame jobs."""
