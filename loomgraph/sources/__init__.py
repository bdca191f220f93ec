"""Graphs from files and tables, and back."""
