"""All core queries and their SQL."""

from __future__ import annotations

from foliospark.plans import assemble, assembly, chapters, jobs, layout, orphans, quality, relational, search, structure, text  # noqa: F401  (each registers its queries)
from foliospark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
