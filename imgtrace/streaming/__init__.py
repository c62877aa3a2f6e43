"""Structured Streaming forms of the feed and fleet jobs."""
