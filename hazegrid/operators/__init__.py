"""DataFrame -> DataFrame operators: filters, joins, aggregates, statistics."""
