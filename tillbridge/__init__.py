"""Retail catalog, stock and order reconciliation as Spark jobs."""
