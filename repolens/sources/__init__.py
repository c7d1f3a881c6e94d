"""Sources and sinks: commit logs, pull-request dumps, description and cost
logs, price lists, source trees, repo maps, run logs, retrieval tables, and
the fixture views over the driver's parquet tables."""
