"""Composed plans: flows, dashboard, and the query registry."""
