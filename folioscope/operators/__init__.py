"""Relational operators over text and the facts found in it."""
