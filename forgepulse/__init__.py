"""Analytics over activity-event streams, as Spark jobs."""
