"""Document analytics on Spark: DataFrame operators keyed by query, document and corpus."""
