"""Composed plans: the scoring pipeline, scan flows and the query catalog."""
