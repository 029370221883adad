"""Survey analytics on Spark: typed tables, survey operators, statistics and exports."""
