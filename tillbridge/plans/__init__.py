"""Queries over the supplied tables, each with an independent SQL check."""

from importlib import import_module

MODULES = ("reconcile", "queues", "catalog", "online", "grids", "people", "inbox", "intake", "texts", "live", "histories")


def load_all() -> None:
    """Import every query module once."""
    for name in MODULES:
        import_module(f"tillbridge.plans.{name}")
