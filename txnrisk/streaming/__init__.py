"""Structured Streaming jobs: scoring, rollup, duplicate suppression, live velocity, enrichment."""
