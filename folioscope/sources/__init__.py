"""Readers of tables, files and their lines."""
