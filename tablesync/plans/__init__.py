"""Whole jobs: staging, transfers and the query catalogue."""
