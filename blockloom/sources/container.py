"""The container that everything lies in: where it is, how large, and whether blocks are shared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = {"GB": 1 << 30, "TB": 1 << 40}
LEAST, MOST = 1 << 30, 8 << 40


@dataclass(frozen=True)
class Container:
    """A container of 1 GB to 8 TB; compression, preallocation and encryption can't be had."""

    location: str
    size: int
    unit: str = "GB"
    dedupe: bool = True

    def __post_init__(self) -> None:
        if not self.location:
            raise ValueError("a container needs a location")
        if self.unit not in UNITS or not LEAST <= self.bytes() <= MOST:
            raise ValueError(f"a container has 1 GB to 8 TB, not {self.size} {self.unit}")

    def bytes(self) -> int:
        return self.size * UNITS[self.unit]


def valid(candidates: DataFrame) -> DataFrame:
    """Those of the candidates (location, size, unit) that Container accepts, with their bytes."""
    each = F.coalesce(*[F.when(F.col("unit") == u, F.lit(n)) for u, n in UNITS.items()])
    return candidates.withColumn("bytes", F.col("size").cast("long") * each).where((F.length("location") > 0) & F.col("bytes").between(LEAST, MOST))
