"""Dealing rows out by ranges of an integer id whose bounds are known before the shuffle."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = -(1 << 63)
MANY = 256


@dataclass
class Ranges:
    bounds: list[int]  # range p holds ids from bounds[p - 1] on, below bounds[p]

    @property
    def n(self) -> int:
        return len(self.bounds) + 1

    def pick(self, key: Column, leaves: list[Column] | None = None) -> Column:
        """The range of key, or that range's leaf: a balanced tree of comparisons.

        More than MANY ranges are told by a binary search among their bounds, whose expression doesn't grow.
        """
        if leaves is None and self.n > MANY:
            return self._searched(key)
        leaves = leaves or [F.lit(p) for p in range(self.n)]

        def tree(a: int, b: int) -> Column:
            if a == b:
                return leaves[a]
            mid = (a + b + 1) // 2
            return F.when(key < F.lit(self.bounds[mid - 1]), tree(a, mid - 1)).otherwise(tree(mid, b))

        return tree(0, self.n - 1)


    def _searched(self, key: Column) -> Column:
        # a constant, folded once
        bounds = F.from_json(F.lit(json.dumps(self.bounds)), "array<bigint>")

        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            right = (acc["lo"] < acc["hi"]) & (key >= F.element_at(bounds, mid + 1))
            return F.struct(
                F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"),
                F.when(right | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"),
            )

        start = F.struct(F.lit(0).alias("lo"), F.lit(len(self.bounds)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(self.bounds).bit_length())), start, halve, lambda acc: acc["lo"])


def id_key(name: str) -> Column:
    """Order of an id column; null comes first."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LEAST))


def id_ranges(df: DataFrame, name: str, parts: int | None = None) -> Ranges:
    """Bounds of ranges with about equally many rows each; only their number reaches the driver."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts < 2:
        return Ranges([])
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(F.percentile_approx(id_key(name), at, 10_000).alias("b")).first()["b"]
    return Ranges(sorted(set(found or []) - {LEAST}))
