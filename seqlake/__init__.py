"""seqlake: ordered, multi-version key-value data as declarative Spark queries."""
