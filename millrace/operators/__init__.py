"""Named table operations. A flow is a list of steps ``{"type": ..., "params": {...}}`` applied in order."""

from . import aggregates, columns, filters, joins, loops, rows, sets, sqlnode  # noqa: F401  (each registers its operations)
from .base import OPERATIONS, Context, apply, register

__all__ = ["OPERATIONS", "Context", "apply", "register"]
