"""Analytics over document knowledge bases, as Spark DataFrame operators."""
