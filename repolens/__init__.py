"""repolens: repository-history analytics as plain Spark DataFrame functions.

Every table is keyed by ``(repo_owner, repo_name)``; every operator is a
function from DataFrames to a DataFrame, so Catalyst sees one plan per query.
"""

REPO = ("repo_owner", "repo_name")

__all__ = ["REPO"]
