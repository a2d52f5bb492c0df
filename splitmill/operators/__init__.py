"""DataFrame operators: exposure, unit aggregation, statistics, reporting, tables."""
