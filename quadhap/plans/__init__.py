"""Queries over the driver tables, each with the SQL that must give the same rows."""

from quadhap.plans import calls, coverage_em, quartets, readers, reads, rerank, sites  # noqa: F401
from quadhap.plans.registry import REGISTRY  # noqa: F401
