"""Incremental use of the analysis cache."""
