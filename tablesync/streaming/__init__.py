"""Structured Streaming forms of the sync: a guarded upsert, an append feed and a test feed."""
