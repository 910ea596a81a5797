"""All registered queries."""

from importlib import import_module

from millrace.catalog.registry import ORACLES, QUERIES

for _module in ("prepare", "sampling", "patterns", "models", "groups", "scores", "sweeps"):
    import_module(f"millrace.catalog.{_module}")

__all__ = ["ORACLES", "QUERIES"]
