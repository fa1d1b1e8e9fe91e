"""A Spark-first engine for duplicate-code analytics, with operators for training data."""
