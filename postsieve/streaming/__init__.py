"""Incremental file ingest with Structured Streaming."""

from postsieve.streaming.ingest import poll, read_landing, score_epochs, score_stream

__all__ = ["poll", "read_landing", "score_epochs", "score_stream"]
