"""Table jobs: joins, windows, aggregates and merges over stored relations."""
