"""DataFrame-to-DataFrame operators: filters, joins, windows, aggregates."""
