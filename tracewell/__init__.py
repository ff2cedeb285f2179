"""Analytics over developer-workspace data, as Spark jobs."""
