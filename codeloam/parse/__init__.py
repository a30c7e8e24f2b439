"""Lexers and light parsers, one for each language."""
