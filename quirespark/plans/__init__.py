"""Queries over the driver's tables."""

from . import catalog, documents, rules, structure

__all__ = ["catalog", "documents", "rules", "structure"]
