"""Fixture views, ordering helpers and the query registry."""
