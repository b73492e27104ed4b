"""Data preparation on Spark: named table operations, analysis queries and ingestion as DataFrame plans."""
