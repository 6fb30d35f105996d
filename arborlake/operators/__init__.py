"""DataFrame operators: joins, windows, groupings and bounded grouped jobs."""
