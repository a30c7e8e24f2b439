"""Renderers: JSON, aligned text and Markdown."""
