"""The query registry."""

from ratelab.queries import files, groups, jobs, speech, text, work  # noqa: F401  (importing registers)
from ratelab.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
