"""DataFrame operators: cleaning, filters, joins, metrics, rules, features, models, table changes."""
