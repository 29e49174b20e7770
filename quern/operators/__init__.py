"""DataFrame operators: deduplication, sampling, aggregates, metrics."""
