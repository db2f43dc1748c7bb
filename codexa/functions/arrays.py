"""Array expressions that check what they assume."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text


def strict_zip(key: Column, **arrays: Column) -> Column:
    """Elements that stand at the same place, as structs. Lists of unequal length, or a missing one among others, fail the query and the message names the key; all missing give NULL."""
    sizes = [F.coalesce(F.size(a), F.lit(-1)) for a in arrays.values()]
    found = F.concat_ws(", ", *[F.concat(F.lit(f"{n} has "), F.when(s < 0, "none").otherwise(s.cast("string"))) for n, s in zip(arrays, sizes, strict=True)])
    problem = F.raise_error(F.concat(F.lit("lists of unequal length at "), text(key.cast("string")), F.lit(": "), found))
    equal = F.lit(True)
    for s in sizes[1:]:
        equal = equal & (s == sizes[0])
    return F.when(equal, F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])).otherwise(problem)
