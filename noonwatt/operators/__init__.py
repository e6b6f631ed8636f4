"""DataFrame operators, each partitioned by caller-given key columns."""
