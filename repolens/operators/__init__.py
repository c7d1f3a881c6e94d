"""Relational operators over the repository-history tables."""
