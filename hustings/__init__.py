"""Discourse analytics on Spark: transcripts to relational and network tables."""
