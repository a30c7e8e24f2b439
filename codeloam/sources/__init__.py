"""Readers of Git trees, directories, configuration and the analysis cache."""
