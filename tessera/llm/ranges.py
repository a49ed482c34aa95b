"""Contiguous ranges of ids with about as many rows each, for any number of ranges.

At most MOST percentiles of the ids come to the driver and into the plan. They part the
ids into cells; where more ranges are wanted, a cell is split evenly by id, an id that fills a cell
or more is split by a hash of its rows, and so are the rows without an id, which come last.
So ranges grow in number with the input, and no id is a range that others wait for. Rows are in
ascending order of id, then of the hash; the range of a row depends on these alone.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST, FAN = 1024, 32


@dataclass(frozen=True)
class Cell:
    """Ids from `low` up to the next cell's; `parts` ranges, the first of them `base`; by hash or by id up to `high`."""

    low: int
    high: int
    parts: int
    by_hash: bool
    base: int


@dataclass(frozen=True)
class Ranges:
    cells: tuple[Cell, ...]
    without_id: int
    """Ranges of rows without an id, after all others."""

    @property
    def with_id(self) -> int:
        return self.cells[-1].base + self.cells[-1].parts if self.cells else 0

    @property
    def n(self) -> int:
        return self.with_id + self.without_id

    def of(self, row_id: Column, row_hash: Column) -> Column:
        """The range of a row."""
        share = row_hash.cast("double") / float(1 << 64) + 0.5

        def part(of_one: Column, parts: Column) -> Column:
            return F.least(F.greatest(F.floor(of_one * parts).cast("long"), F.lit(0).cast("long")), parts - 1)

        none = F.lit(self.with_id) + part(share, F.lit(self.without_id).cast("long"))
        if not self.cells:
            return none.cast("int")
        cell = _upto(row_id, [c.low for c in self.cells[1:]])
        pick = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), cell + 1)
        number = pick([c.base for c in self.cells], "long")
        if any(c.parts > 1 for c in self.cells):
            low = pick([c.low for c in self.cells], "long")
            width = pick([float(max(1, c.high - c.low)) for c in self.cells], "double")
            where = F.when(pick([c.by_hash for c in self.cells], "boolean"), share).otherwise((row_id.cast("double") - low.cast("double")) / width)
            number = number + part(where, pick([c.parts for c in self.cells], "long"))
        return F.when(row_id.isNull(), none).otherwise(number).cast("int")


def _upto(column: Column, splits: list[int]) -> Column:
    """How many splits are not above the column. Two levels, so a row costs few comparisons."""
    if not splits:
        return F.lit(0)

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda s: s <= column))

    groups = [splits[i : i + FAN] for i in range(0, len(splits), FAN)]
    coarse = upto(F.array(*(F.lit(g[0]) for g in groups)))
    fine = F.element_at(F.array(*(F.array(*(F.lit(s) for s in g)) for g in groups)), F.greatest(coarse, F.lit(1)))
    return (F.greatest(coarse, F.lit(1)) - 1) * FAN + upto(fine)


def id_ranges(df: DataFrame, column: str, n: int) -> Ranges:
    """About n ranges of the ids (long) in a column, from one aggregate."""
    points = max(1, min(n, MOST))
    key = F.col(column).cast("long")
    at = F.percentile_approx(key, [i / points for i in range(1, points)], 10 * points) if points > 1 else F.lit(None)
    total, with_id, least, most, found = df.agg(F.count("*"), F.count(key), F.min(key), F.max(key), at).first()
    without = max(1, round(n * (total - with_id) / max(1, total)))
    if not with_id:
        return Ranges((), without)
    times = Counter(found or [])
    full = {i: k for i, k in times.items() if k > 1}
    starts = sorted({least, *times, *(i + 1 for i in full if i < most)})
    cells, base = [], 0
    for low, after in zip(starts, [*starts[1:], most + 1], strict=True):
        parts = max(1, round(n * full[low] / points)) if low in full else -(-n // points)
        cells.append(Cell(low, after, parts, low in full, base))
        base += parts
    return Ranges(tuple(cells), without)
