"""Training-data operators: dedup, filters, models, tokens and shards as Spark jobs."""
