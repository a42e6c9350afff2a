"""tidewire: a Spark-first engine for story intelligence over article, page and event records."""
