"""quern: a Spark-first engine for bulk embedding analytics."""
