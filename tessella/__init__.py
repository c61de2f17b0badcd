"""Document ingestion, clustering and faceted search as Spark DataFrame plans."""
