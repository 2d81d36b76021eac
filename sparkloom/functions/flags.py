"""Sets of flags held in the bits of a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of failure that a stage's log may show.
FAILURES = {"CanceledDueToTimeout": 1, "DotNetTestsRunFailure": 2, "DotNetBuildFailure": 4, "TimeoutDueToLongRunningTest": 8}


def lowest(mask: Column) -> Column:
    """The lowest flag that is set; 0 if none is."""
    return mask.bitwiseAND(-mask)


def up_to(mask: Column, most: Column) -> Column:
    """The flags that are not above a given one."""
    return mask.bitwiseAND(most * 2 - 1)


def has_any(mask: Column, wanted: Column | int) -> Column:
    return mask.bitwiseAND(wanted) != 0


def names_of(mask: Column, names: dict[str, int]) -> Column:
    """Names of the flags that are set, from the lowest up."""
    known = F.array(*(F.when(has_any(mask, F.lit(v)), F.lit(k)) for k, v in sorted(names.items(), key=lambda x: x[1])))
    return F.array_compact(known)


def union(mask: Column) -> Column:
    """Of a group: all flags that are set in any row."""
    return F.bit_or(mask)
