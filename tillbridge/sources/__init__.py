"""Readers of till tables, payload streams and landed storefront pages."""
