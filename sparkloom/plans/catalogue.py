"""Every query of the library by name, and the SQL that gives the same rows in another engine."""

from sparkloom.plans import changes, knowledge, records, reviews, texts, work  # noqa: F401  they register their queries
from sparkloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
