"""Joins by grid, strip, order and range, and packing, against plain loops; and on pages and texts that are very large."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.geometry import overlap
from lectern.operators import chunks, formulas, lines, spatial, tables

KEYS = ["doc_id", "page"]


def boxes(n, seed, size=200.0, name="bbox", pages=3):
    """Rectangles small, wide, inverted, on cell borders and far outside."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y = r.choice([r.uniform(-300, 900), 128.0 * r.randrange(-2, 8), 0.0]), r.choice([r.uniform(-300, 1500), 128.0 * r.randrange(-2, 8)])
        w, h = r.choice([0.0, r.uniform(0, size), 128.0, -5.0, 3000.0]), r.choice([0.0, r.uniform(0, size), 128.0, 3000.0])
        out.append((1, r.randrange(pages), k, [x, y, x + w, y + h]))
    return [*out, (1, 0, n, None), (1, 0, n + 1, [float("inf"), 0.0, float("inf"), 1.0]), (1, 1, n + 2, [-1e300, -1e300, 1e300, 1e300]), (None, 1, n + 3, [0.0, 0.0, 1.0, 1.0])]


@pytest.mark.parametrize("pad", [0, 3])
def test_touching(spark, pad):
    a = spark.createDataFrame(boxes(250, 1), "doc_id long, page int, a long, bbox array<double>")
    b = spark.createDataFrame(boxes(120, 2), "doc_id long, page int, b long, region array<double>")
    found = [tuple(r) for r in spatial.touching(a, b, KEYS, pad=pad).select("a", "b").collect()]
    plain = [tuple(r) for r in a.join(b, KEYS).where(overlap(F.col("bbox"), F.col("region"), pad)).select("a", "b").collect()]
    assert len(plain) > 1000
    assert sorted(found) == sorted(plain)


def test_spans_outside_regions(spark):
    a = spark.createDataFrame([*boxes(200, 3), *boxes(200, 3)[:5]], "doc_id long, page int, a long, bbox array<double>")
    b = spark.createDataFrame([x for x in boxes(6, 4) if x[3] is None or x[3][2] < 1e6], "doc_id long, page int, b long, bbox array<double>")
    near = (a["doc_id"] == b["doc_id"]) & (a["page"] == b["page"]) & overlap(a["bbox"], b["bbox"], 3)
    plain = sorted(r["a"] for r in a.join(b, near, "left_anti").collect())
    assert sorted(r["a"] for r in lines.outside_regions(a, b).collect()) == plain and 0 < len(plain) < 205


def formula_rows(n, tall=()):
    r = random.Random(6)
    out = []
    for k in range(n):
        y, x, h = r.uniform(0, 6000), r.choice([40.0, 72.0, 300.0, 500.0]), 10.0
        text = r.choice(["a = b", "(7)", "words", "words that end so (12)", "c / d"])
        out.append((1, k % 2, k, text, [x, y, x + r.choice([60.0, 130.0]), y + (3000.0 if k in tall else h)], 600.0))
    return out


def test_regions_by_strips(spark, monkeypatch):
    """The same regions as with all lines of the page, with lines so tall that they reach far."""
    rows = spark.createDataFrame(formula_rows(400, tall={5, 30, 31}), "doc_id long, page int, line_no long, text string, bbox array<double>, page_w double")
    ask = lambda: [sorted(map(str, f(rows).collect())) for f in (formulas.numbered_equations, formulas.displayed_equations)]
    found = ask()
    monkeypatch.setattr(formulas, "close_by", lambda anchors, others, keys, **_: anchors.join(others, keys))
    assert found == ask() and all(found)


def test_page_of_very_many_lines(spark):
    """100,000 lines on one page: pairs grow with the lines."""

    def pairs(n):
        rows = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("line_no"), F.lit("a = b").alias("text"), F.expr("array(72D, id * 40D, 300D, id * 40D + 10)").alias("bbox"), F.lit(600.0).alias("page_w"))
        region = rows.where("line_no % 10 = 0").select("doc_id", "page", F.col("bbox").alias("region"))
        middle = (F.col("bbox")[1] + F.col("bbox")[3]) / 2
        others = rows.select(*KEYS, ((F.col("bbox")[1] + F.col("bbox")[3]) / 2).alias("m"))
        near = spatial.close_by(rows.select(*KEYS, "bbox"), others, KEYS, at=middle, reach=F.lit(160.0), place=F.col("m"), bounded=True)
        return rows, spatial.touching(rows.select(*KEYS, "bbox"), region, KEYS, pad=3).count(), near.count()

    (_, touch_s, near_s), (rows, touch, near) = pairs(10_000), pairs(100_000)
    assert (touch_s, touch) == (1_000, 10_000)
    assert near <= 10.01 * near_s and near <= 20 * 100_000
    assert formulas.displayed_equations(rows).count() == 100_000


def test_next_below(spark):
    r = random.Random(9)
    caps = [(1, k % 3, k, float(r.randrange(60))) for k in range(60)] + [(1, 0, 99, None)]
    own = [(1, k % 3, [float(r.randrange(3)), float(r.randrange(60)), float(k), 0.0]) for k in range(45)] + [(1, 1, None), (2, 0, [0.0, 0.0, 0.0, 0.0])]
    a = spark.createDataFrame(caps, "doc_id long, page int, k long, top double")
    b = spark.createDataFrame(own, "doc_id long, page int, region array<double>").withColumns({"y": F.col("region")[1], "x": F.col("region")[0]})
    found = {x["k"]: x["region"] for x in spatial.next_below(a, b, KEYS, start="top", place=["y", "x", "region"], value="region").collect()}
    for d, p, k, top in caps:
        below = [(g[1], g[0], g) for e, q, g in own if (e, q) == (d, p) and g and top is not None and g[1] >= top]
        assert found[k] == (min(below)[2] if below else None)


def test_nearest_region_ties(spark):
    """A region beside the caption goes before one below; of one height the left one."""
    caps = spark.createDataFrame([(1, 1, "Table 1 - a", [72.0, 100.0, 200.0, 110.0], 600.0, 800.0)], "doc_id long, page int, text string, bbox array<double>, page_w double, page_h double")
    for own, best in (([[50.0, 93.0], [60.0, 95.0], [40.0, 111.0]], 60.0), ([[70.0, 120.0], [30.0, 120.0], [1.0, 121.0]], 30.0)):
        regions = spark.createDataFrame([(1, 1, [*x, 500.0, 400.0]) for x in own], "doc_id long, page int, bbox array<double>")
        assert tables.placed(tables.captions(caps), regions).first()["bbox"][0] == best


def test_within_ranges(spark):
    r = random.Random(3)
    ranges = [(d, k, a, a + r.choice([0, 0, 1, 5, 1000, -1])) for d in (1, 2) for k in range(40) for a in [r.randrange(50)]] + [(1, 99, None, 5), (3, 0, 1, 5), (1, 0, 3, 4), (1, 0, 3, 4)]
    points = [(d, r.randrange(-5, 60), f"p{k}") for d in (1, 2) for k in range(50)] + [(4, 1, "x"), (1, None, "y"), (1, 7, "z"), (1, 7, "z")]
    a = spark.createDataFrame(ranges, "doc_id long, k long, low int, high int")
    b = spark.createDataFrame(points, "doc_id long, at int, name string")
    found = sorted((x["doc_id"], x["k"], x["low"], x["at"], x["name"]) for x in spatial.within_ranges(a, b, "doc_id", low="low", high="high", at="at").collect())
    assert found == sorted((d, k, lo, at, n) for d, k, lo, hi in ranges for e, at, n in points if d == e and lo is not None and at is not None and lo <= at <= hi)


def plain_groups(lengths, longest):
    out, room = [], 0
    for k, n in enumerate(lengths):
        if not k or room + n > longest:
            out.append(k)
            room = 0
        room += n
    return out


def test_starts_of_chunks(spark):
    r = random.Random(2)
    cases = [[], [5], [0, 0, 0], [200], [200, 200], *[[r.choice([0, 1, 3, 50, 99, 100, 101, 250]) for _ in range(n)] for n in (2, 3, 4, 7, 8, 9, 64, 65, 1000)]]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, lengths array<int>")
    for x in df.select("lengths", chunks.starts(F.col("lengths"), 100).alias("at")).collect():
        assert x["at"] == plain_groups(x["lengths"], 100)


def test_text_of_100_mb(spark):
    """One text of 100 million characters: every paragraph once, in order, in full chunks."""
    n = 250_000
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("p"), F.lpad(i.cast("string"), 7, "0"), F.repeat(F.lit(" word"), 78))), "\n")
    out = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text")).select("doc_id", F.posexplode(chunks.packed(F.transform(F.split("text", "\n"), lambda p: F.concat(p, F.lit("\n\n"))), 1800)).alias("no", "text"))
    found = out.agg(F.count("*"), F.max(F.length("text")), F.sum(F.regexp_count("text", F.lit("p0"))), F.min(F.expr("int(substr(text, 2, 7)) = no * 4 + 1")), F.sum(F.length("text"))).first()
    assert found[0] == math.ceil(n / 4) and found[1] <= 1800 and found[2] == n and found[3] and found[4] > 99_000_000


def drawings(rows):
    return [(1, p, k, [float(v) for v in b], 600.0, 800.0) for p, k, b in rows]


DRAWN = "doc_id long, page int, drawing_no long, bbox array<double>, page_w double, page_h double"


def test_clusters_of_many_drawings(spark, monkeypatch):
    """First fit by numpy and by the fold are the same, whatever touches."""
    r = random.Random(12)
    rows = [(p, k, (x, y, x + r.choice([1, 30, -2]), y + r.choice([1, 30]))) for p in range(4) for k in range(150) for x, y in [(r.uniform(0, 550), r.uniform(0, 750))]]
    df = spark.createDataFrame(drawings(rows), DRAWN)
    pages = df.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("drawing_no", "bbox"))).alias("drawn"), F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"))
    found = sorted(map(str, tables._clusters(pages).collect()))
    monkeypatch.setattr(tables, "FOLDED", 0)
    assert sorted(map(str, tables._clusters(pages).collect())) == found


def test_page_of_20000_drawings(spark):
    """A table of many rules among specks that are all apart."""
    grid = [(1, k, (100 + 10 * (k % 40), 100 + 10 * (k // 40), 110 + 10 * (k % 40), 110 + 10 * (k // 40))) for k in range(1000)]
    specks = [(1, 1000 + k, (50.0 * (k % 150) + 900, 50.0 * (k // 150), 50.0 * (k % 150) + 901, 50.0 * (k // 150) + 1)) for k in range(19_000)]
    found = tables.ruled_regions(spark.createDataFrame(drawings(grid + specks), DRAWN)).collect()
    assert [x["bbox"] for x in found] == [[100.0, 100.0, 500.0, 350.0]]


def test_drawings_of_a_page_come_in_parts(spark):
    """A page's drawings are never one row: clusters are the same whether a page ends within a batch or goes on in the next; nulls touch nothing."""
    r = random.Random(3)
    boxes = {page: [(x, y, x + r.choice([1, 30, -20]), y + r.choice([1, 30])) for _ in range(700) for x, y in [(r.uniform(0, 300), r.uniform(0, 700))]] for page in (1, 2)}
    rows = [(p, k, b) for p, found in boxes.items() for k, b in enumerate(found)]
    df = spark.createDataFrame([*drawings(rows), (1, 2, 700, None, 600.0, 800.0)], DRAWN)
    plan = tables.ruled_regions(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    whole = sorted((x.page, x.bbox) for x in tables.ruled_regions(df).collect())
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
        assert sorted((x.page, x.bbox) for x in tables.ruled_regions(df).collect()) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    expected = []
    for page, found in boxes.items():
        clusters = []
        for b in found:
            for c in clusters:
                o = c[0]
                if b[2] >= o[0] - 14 and o[2] >= b[0] - 14 and b[3] >= o[1] - 14 and o[3] >= b[1] - 14:
                    c[:] = [(min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3])), c[1] + 1]
                    break
            else:
                clusters.append([b, 1])
        found = []
        for b in sorted((c[0] for c in clusters if c[1] >= 18 and (c[0][2] - c[0][0]) * (c[0][3] - c[0][1]) >= 600 * 800 * 0.02), key=lambda b: (b[1], b[0])):
            o = found[-1] if found else None
            if o and b[2] >= o[0] - 10 and o[2] >= b[0] - 10 and b[3] >= o[1] - 10 and o[3] >= b[1] - 10:
                found[-1] = (min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3]))
            else:
                found.append(b)
        expected += [(page, list(map(float, b))) for b in found]
    assert whole == sorted(expected)
