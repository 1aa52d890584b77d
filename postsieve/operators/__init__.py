"""DataFrame operators: scoring, targets, deduplication, queue, alerts, counts, health."""
