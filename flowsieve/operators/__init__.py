"""DataFrame-to-DataFrame operators: joins, aggregates, windows, table upkeep."""
