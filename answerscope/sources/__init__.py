"""Readers, writers and the crawl cache."""
