"""Joins by place: rectangles by grid cells, rows by strips of height, rows by the next place below.

A rectangle is copied to the cells of a grid that it covers, so only
rectangles that share a cell are held against each other, and a page of any
number of lines is spread over as many keys as it has cells. Of all cells that
two rectangles share one owns the pair and reports it. Rectangles that cover
more than ``WIDE`` cells, or whose corners are no numbers, are not copied but
meet the other side by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.geometry import overlap

#: Side of a cell, cells that a rectangle is copied to at most, height of a strip, strips that a reach is copied to at most.
CELL, WIDE, STRIP, TALL = 128.0, 64, 160.0, 8
#: Coordinates from here on count as no numbers.
FAR = 1e9


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _covered(low: Column, high: Column, size: float) -> Column:
    """How many cells from ``low`` to ``high``; null where these are no numbers of usual size."""
    return F.when((F.abs(low) < FAR) & (F.abs(high) < FAR), _cell(high, size) - _cell(low, size) + 1)


def _fits(cells: Column, most: int) -> Column:
    return F.coalesce(cells <= most, F.lit(False))


def touching(left: DataFrame, right: DataFrame, keys: list[str], *, pad: float = 0, box: str = "bbox", other: str = "region") -> DataFrame:
    """Pairs of rows with equal ``keys`` whose rectangles ``box`` and ``other`` touch within ``pad``, each pair once.

    Columns of both sides but for the second ``keys``. Rows without a
    rectangle or key have no pair.
    """
    a, b = F.col(box), F.col(other)
    grown = F.array(b[0] - pad, b[1] - pad, b[2] + pad, b[3] + pad)
    corners = lambda r: (F.least(r[0], r[2]), F.least(r[1], r[3]), F.greatest(r[0], r[2]), F.greatest(r[1], r[3]))

    def small(r: Column) -> Column:
        x0, y0, x1, y1 = corners(r)
        return _fits(_covered(x0, x1, CELL) * _covered(y0, y1, CELL), WIDE)

    def copied(rows: DataFrame, r: Column) -> DataFrame:
        x0, y0, x1, y1 = corners(r)
        return rows.where(small(r)).withColumn("__cx", F.explode(F.sequence(_cell(x0, CELL), _cell(x1, CELL)))).withColumn("__cy", F.explode(F.sequence(_cell(y0, CELL), _cell(y1, CELL))))

    meet = overlap(a, b, pad)
    owns = (F.col("__cx") == _cell(F.greatest(a[0], b[0] - pad), CELL)) & (F.col("__cy") == _cell(F.greatest(a[1], b[1] - pad), CELL))
    pairs = copied(left, a).join(copied(right, grown), [*keys, "__cx", "__cy"]).where(meet & owns).drop("__cx", "__cy")
    # A wide rectangle on the left meets all of its page, one on the right all others.
    first = left.where(a.isNotNull() & ~small(a)).join(right, keys).where(meet)
    second = left.where(small(a)).join(right.where(b.isNotNull() & ~small(grown)), keys).where(meet)
    return pairs.unionByName(first).unionByName(second)


def close_by(anchors: DataFrame, rows: DataFrame, keys: list[str], *, at: Column, reach: Column, place: Column, bounded: bool) -> DataFrame:
    """Pairs of anchors and rows with equal ``keys`` where ``place`` is within ``reach`` of ``at``, and some more: the caller's own condition is to follow.

    A row lies in one strip and an anchor in those that it reaches, at most
    ``TALL``; an anchor that reaches further meets the page, unless ``bounded``
    says that there is none.
    """
    strips = _covered(at - reach, at + reach, STRIP)
    low = anchors.where(_fits(strips, TALL)) if not bounded else anchors
    near = low.withColumn("__strip", F.explode(F.sequence(_cell(at - reach, STRIP), _cell(at + reach, STRIP))))
    out = near.join(rows.withColumn("__strip", _cell(place, STRIP)), [*keys, "__strip"]).drop("__strip")
    return out if bounded else out.unionByName(anchors.where(~_fits(strips, TALL)).join(rows, keys))


def next_below(rows: DataFrame, others: DataFrame, keys: list[str], *, start: str, place: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` of the first of ``others``, by ``place``, whose first ``place`` is at least ``start``; null where there is none.

    A merge of both sides in one order, not a join: linear in rows on a page.
    """
    kept = rows.columns
    side = F.struct(*[F.col(c) for c in kept])
    own = rows.select(*keys, side.alias("__row"), F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(others.schema[value].dataType).alias(value), *[F.lit(None).cast(others.schema[c].dataType).alias(f"__p{k}") for k, c in enumerate(place)])
    there = others.where(F.col(place[0]).isNotNull()).select(*keys, F.lit(None).cast(own.schema["__row"].dataType).alias("__row"), F.col(place[0]).alias("__at"), F.lit(1).alias("__kind"), value, *[F.col(c).alias(f"__p{k}") for k, c in enumerate(place)])
    up = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.desc("__kind"), *[F.desc(f"__p{k}") for k in range(len(place))])
    found = F.when(F.col("__at").isNotNull(), F.last(value, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    merged = own.unionByName(there).withColumn("__found", found).where("__kind = 0")
    return merged.select(*[F.col("__row")[c].alias(c) for c in kept], F.col("__found").alias(value))


def within_ranges(ranges: DataFrame, points: DataFrame, by: str, *, low: str, high: str, at: str) -> DataFrame:
    """Pairs of ranges and points of one ``by`` with ``low <= at <= high``.

    The different points of a group are numbered in order; a range becomes the
    run of numbers between its cuts, counted in one sweep over points, lower and
    upper bounds, and meets its points by number. So rows are made for pairs
    only. Columns of both sides but for the second ``by``.
    """
    places = points.where(F.col(at).isNotNull()).select(by, F.col(at).alias("__at")).distinct().withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("__at")))
    side = F.struct(*ranges.columns)
    empty = F.lit(None).cast(ranges.select(side.alias("x")).schema["x"].dataType)
    cuts = ranges.where(F.col(low) <= F.col(high)).select(by, side.alias("__row"), F.col(low).alias("__at"), F.lit(0).alias("__kind"))
    marks = cuts.unionByName(places.select(by, empty.alias("__row"), "__at", F.lit(1).alias("__kind")))
    before = Window.partitionBy(by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    started = marks.withColumn("__low", F.sum((F.col("__kind") == 1).cast("long")).over(before)).where("__kind = 0").select(by, "__row", "__low", F.col("__row")[high].alias("__at"), F.lit(2).alias("__kind"))
    marks = started.unionByName(places.select(by, empty.alias("__row"), F.lit(None).cast("long").alias("__low"), "__at", F.lit(1).alias("__kind")))
    runs = marks.withColumn("__high", F.sum((F.col("__kind") == 1).cast("long")).over(before)).where("__kind = 2 and __low < __high")
    runs = runs.select(by, "__row", F.explode(F.sequence(F.col("__low") + 1, F.col("__high"))).alias("__n"))
    placed = points.join(places, (points[by] == places[by]) & (points[at] == places["__at"])).select(points["*"], places["__n"].cast("long").alias("__n"))
    met = runs.join(placed, [by, "__n"])
    return met.select(*[F.col("__row")[c].alias(c) for c in ranges.columns], *[c for c in points.columns if c != by])
