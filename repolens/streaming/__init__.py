"""Structured Streaming intake of new commit-log files."""
