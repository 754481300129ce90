"""Whole runs, from queries to answers."""
