"""Plan helpers shared by operators (size-checked broadcast, per-group top-n)
and the registry of named queries with their SQL oracles."""
