"""Shipment analytics on Spark: cleaning, joins, metrics, rules, models and alert streams."""
