"""Resumable jobs over a queue of work."""
