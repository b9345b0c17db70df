"""Incremental upkeep of the crawl cache with Structured Streaming."""
