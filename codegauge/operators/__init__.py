"""DataFrame operators: selection, rules, metrics, scoring, joins, reports, audits."""
