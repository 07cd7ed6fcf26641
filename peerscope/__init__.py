"""Network-flow analytics on Spark: enrichment, layout, pruning and streaming ingest."""
