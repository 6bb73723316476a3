"""Named queries over the bound tables."""

from quaymark.plans import ledgers, lending, market, performance, studies, trading  # noqa: F401
from quaymark.plans.registry import QUERIES

__all__ = ["QUERIES"]
