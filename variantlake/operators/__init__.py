"""DataFrame operators: loads, joins, analysis, report tables."""
