"""Listing ingestion, lexicon scoring, first-seen deduplication and alert queues on Spark."""
