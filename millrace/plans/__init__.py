"""The query catalogue with its SQL."""

from . import catalogue  # noqa: I001
from . import audits, signals  # they add their queries to the catalogue

__all__ = ["audits", "catalogue", "signals"]
