"""Document fingerprints by winnowing: rolling k-gram hashes, the least of each window with rightmost ties, positions kept.

The k-grams of a text are its runs of ``K`` code points (a shorter text is one
k-gram, an empty or null one has none); of every ``WINDOW`` consecutive k-grams
(all, if fewer) the one with the least hash is kept, of equal ones the
rightmost. So any passage of ``K + WINDOW - 1`` code points that two texts
share gives them a common hash, and its positions tell where; nothing shorter
than ``K`` code points matches. Hashes have 49 bits.

Everything is DataFrame functions. A text is cut into pieces of ``PIECE``
k-grams that overlap by a window, so each window lies in one piece, and pieces
into blocks of ``WINDOW / 2`` k-grams. A window holds at least one whole block,
so what it keeps is no larger than the largest of the minima of the blocks
about it; only the few k-grams that pass this are held against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import shuffles

#: Code points of a k-gram, k-grams of a window, and of a piece (with the overlap fewer than 2^POSITION_BITS).
K, WINDOW, PIECE, POSITION_BITS = 16, 64, 16384, 15
#: Code points of the pieces that very long texts are cut into first, since a cut counts code points from the start.
LONG = 1 << 20
#: Bytes of text in a range of ids, the most ranges (their bounds are held by the driver), and bytes in a task.
RANGE_BYTES, RANGES, TASK_BYTES = 2 << 20, 10_000, 16 << 20

FINGERPRINT = "array<struct<position:int,hash:bigint>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _cuts(text: Column, size: int, overlap: int, least: int) -> Column:
    """Cuts of ``size + overlap`` code points, one each ``size``; none but the first that hold fewer than ``least`` code points."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - least, F.lit(0)) / size).cast("int")), lambda p: F.substring(text, p * size + 1, F.lit(size + overlap)))


def _blocks(piece: Column) -> Column:
    """Of each block of a piece, its keys: hash, then place from the right, so that keys differ and the rightmost of equal hashes is least.

    A block of one-byte letters is cut as bytes, which needs no count of letters.
    """
    half, last = WINDOW // 2, (1 << POSITION_BITS) - 1
    key = lambda gram, end, i: F.shiftleft(F.xxhash64(gram), POSITION_BITS) + (end - i)

    def keys(z: Column, b: Column) -> Column:
        def of_block(end: Column) -> Column:
            every = F.array(*[F.lit(i) for i in range(1, half + 1)])
            places = lambda raw: F.when(F.length(raw) == half + K - 1, every).otherwise(F.sequence(F.lit(1), F.greatest(F.length(raw) - (K - 1), F.lit(1))))
            plain = lambda raw: F.transform(places(raw), lambda i: key(F.substring(raw, i, F.lit(K)), end, i))
            return F.when(F.length(z) == F.octet_length(z), _let(z.cast("binary"), plain)).otherwise(plain(z))

        return _let(F.lit(last) - b * half, of_block)

    coarse = _cuts(piece, 32 * half, K - 1, K)
    return F.transform(F.flatten(F.transform(coarse, lambda q: _cuts(q, half, K - 1, K))), keys)


def _left(blocks: Column) -> Column:
    """Of each block, the keys that may be the least of a window."""

    def few(mins: Column) -> Column:
        bound = lambda b: F.array_max(F.slice(mins, F.greatest(b, F.lit(1)), F.when(b == 0, 2).otherwise(3)))
        return F.transform(blocks, lambda keys, b: _let(bound(b), lambda most: F.filter(keys, lambda k: k <= most)))

    return _let(F.transform(blocks, lambda keys: F.array_min(keys)), few)


def _kept(piece: Column) -> Column:
    """Keys of a piece that are the least of one of its windows, by place."""
    low = F.lit((1 << POSITION_BITS) - 1)

    def chosen(n: Column) -> Column:
        def stays(pool: Column, k: Column) -> Column:
            """Whether the places between the next smaller keys to both sides have room for a window; places are counted from the right."""

            def room(smaller: Column) -> Column:
                before = F.array_min(F.transform(smaller, lambda o: F.when(o.bitwiseAND(low) > k.bitwiseAND(low), o.bitwiseAND(low))))
                after = F.array_max(F.transform(smaller, lambda o: F.when(o.bitwiseAND(low) < k.bitwiseAND(low), o.bitwiseAND(low))))
                return F.coalesce(before, low) - F.coalesce(after, low - 1 - n) > F.least(F.lit(WINDOW), n)

            return _let(F.filter(pool, lambda o: o < k), room)

        def of_blocks(left: Column) -> Column:
            def of_block(own: Column, b: Column) -> Column:
                near = F.flatten(F.slice(left, F.greatest(b - 1, F.lit(1)), F.least(b, F.lit(2)) + 3))
                return F.when(F.size(own) > 0, _let(near, lambda pool: F.filter(own, lambda k: stays(pool, k)))).otherwise(own)

            return F.flatten(F.transform(left, of_block))

        return _let(_let(_blocks(piece), _left), of_blocks)

    return _let(F.greatest(F.length(piece) - (K - 1), F.lit(1)), chosen)


def _merged(*parts: Column) -> Column:
    """Entries of short arrays, each once, by position."""
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def fingerprint(text: Column) -> Column:
    """Kept k-grams of a text as ``FINGERPRINT``, by position (from 0, in code points). Null and empty texts: an empty array."""
    last, least = (1 << POSITION_BITS) - 1, K + WINDOW - 1
    full = F.coalesce(text, F.lit(""))
    place = lambda k: F.lit(last) - k.bitwiseAND(F.lit(last))
    longs = _cuts(full, LONG, least - 1, least)
    pieces = F.flatten(F.transform(longs, lambda long: _cuts(long, PIECE, least - 1, least)))

    def of_pieces(kept: Column) -> Column:
        """What a window at the border of two pieces keeps may be in both of them."""

        def entries(keys: Column, p: Column) -> Column:
            return F.transform(keys, lambda k: F.struct((p * PIECE - 1 + place(k)).cast("int").alias("position"), F.shiftrightunsigned(k, POSITION_BITS).alias("hash")))

        def of_piece(keys: Column, p: Column) -> Column:
            begin = entries(F.filter(keys, lambda k: place(k) < WINDOW), p)
            before = entries(F.filter(F.get(kept, p - 1), lambda k: place(k) > PIECE), p - 1)
            border = F.when(p == 0, begin).otherwise(_merged(begin, before))
            return F.concat(border, entries(F.filter(keys, lambda k: (place(k) >= WINDOW) & ((place(k) <= PIECE) | (p == F.size(kept) - 1))), p))

        return F.when(F.size(kept) == 1, entries(F.get(kept, F.lit(0)), F.lit(0))).otherwise(F.flatten(F.transform(kept, of_piece)))

    return F.when(full == "", F.array().cast(FINGERPRINT)).otherwise(_let(F.transform(pieces, _kept), of_pieces))


def joint(whole: Column, first_chars: Column, second_chars: Column) -> Column:
    """The code points of ``whole`` that windows across the joint of its two parts lie in."""
    span = F.lit(K + WINDOW - 2)
    return F.substring(whole, F.greatest(first_chars - span, F.lit(0)) + 1, F.least(first_chars, span) + F.least(second_chars, span))


def spliced(first: Column, first_chars: Column, second: Column, second_chars: Column, across: Column) -> Column:
    """The fingerprint of the first ``first_chars`` code points of one text and then the first ``second_chars`` of another, from their fingerprints and that of the joint.

    Of either text stays what windows keep that lie in its part; a kept k-gram
    is first kept by the window that starts after the one kept before it or,
    where it is the lesser, by the window that it ends.
    """
    span = K + WINDOW - 2

    def part(fp: Column, chars: Column) -> Column:
        def inside(x: Column, i: Column) -> Column:
            before = F.get(fp, i - 1)
            sooner = F.shiftleft(x["hash"], POSITION_BITS) <= F.shiftleft(before["hash"], POSITION_BITS)
            start = F.when(i == 0, 0).when(sooner, F.greatest(x["position"] - (WINDOW - 1), F.lit(0))).otherwise(before["position"] + 1)
            return start + span < chars

        return F.filter(fp, inside)

    def moved(fp: Column, by: Column) -> Column:
        return F.transform(fp, lambda x: F.struct((x["position"] + by).cast("int").alias("position"), x["hash"].alias("hash")))

    def joined(own: Column) -> Column:
        def both(other: Column) -> Column:
            low, high = lambda x: x["position"] < first_chars - span, lambda x: x["position"] >= first_chars + span
            wide = F.least(first_chars, F.lit(span)) + F.least(second_chars, F.lit(span)) > span
            between = F.when(wide, moved(across, F.greatest(first_chars - span, F.lit(0)))).otherwise(F.array().cast(FINGERPRINT))
            middle = _merged(F.filter(own, lambda x: ~low(x)), between, F.filter(other, lambda x: ~high(x)))
            return F.concat(F.filter(own, low), middle, F.filter(other, high))

        return _let(moved(part(second, second_chars), first_chars), both)

    return F.when(first_chars + second_chars <= span, across).otherwise(_let(part(first, first_chars), joined))


def hashes(fp: Column) -> Column:
    """The different hashes of a fingerprint."""
    return F.array_distinct(F.transform(fp, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes, 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def written(fp: Column) -> Column:
    """A fingerprint as text: ``position:hash`` in hexadecimal, by position, with a space between."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.concat(F.hex(x["position"]), F.lit(":"), F.hex(x["hash"])))), " ")


def fingerprints(docs: DataFrame, *, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as the column ``name``; no shuffle, rows and other columns as they are."""
    return docs.withColumn(name, fingerprint(F.col(text)))


def shared_passages(prints: DataFrame, *, doc_id: str = "doc_id", name: str = "fingerprint") -> DataFrame:
    """Of each hash that documents share: the first place of it (least id, then position) and every other one.

    Rows ``hash``, ``doc_id``, ``position``, ``first_id``, ``first_position``:
    one a place besides the first, never a pair of all places. Null ids take
    no part.
    """
    places = prints.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.explode(name).alias("x")).select("doc_id", "x.hash", "x.position").distinct()
    first = places.groupBy("hash").agg(F.min(F.struct("doc_id", "position")).alias("first"), F.count("*").alias("n")).where("n > 1")
    out = places.join(first, "hash").where(F.struct("doc_id", "position") != F.col("first"))
    return out.select("hash", "doc_id", "position", F.col("first.doc_id").alias("first_id"), F.col("first.position").alias("first_position"))


def _bounds(keys: DataFrame, n: int) -> list[int]:
    """Ascending bounds that cut the ids into ``n`` ranges of about the same number of rows; repeated for ids that fill several."""
    if n < 2:
        return []
    shares = [k / n for k in range(1, n)]
    return sorted(keys.agg(F.percentile_approx("k", shares, 10 * n)).first()[0] or [])


def _range_of(bounds: list[int], key: Column, tie: Column) -> Column:
    """The range of an id; an id that fills several is dealt over them by ``tie``, ascending."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in rows])
    heads = F.array(*[F.lit(r[0]).cast("long") for r in rows])

    def below(test) -> Column:
        """Bounds that pass the test, which holds for a prefix of them."""
        row = F.size(F.filter(heads, test))
        return F.when(row == 0, 0).otherwise((row - 1) * step + F.size(F.filter(F.get(fine, row - 1), test)))

    low, to = below(lambda x: x < key), below(lambda x: x <= key)
    unit = F.shiftrightunsigned(tie.bitwiseXOR(F.lit(-(1 << 63))), 33) / float(1 << 31)
    return low + F.floor(unit * (to - low + 1)).cast("int")


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text``, ``fp`` (its fingerprint), ``next_text`` and ``next_fp``, of the next row by descending id.

    After the last row comes the first. Ids are integers; null ones are last
    (as -2^63). Rows with one id are ordered by a hash of the text, then by the
    text. Null texts are empty. Other columns are left out.

    Rows are dealt to ranges of ids once; the first row of each range goes as a
    guest to the range that comes before it as well.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = _bounds(own, min(RANGES, max(1, -(-size // RANGE_BYTES))))
    own = own.withColumn("tie", F.xxhash64("text")).withColumn("part", _range_of(bounds, F.col("k"), F.col("tie")))
    tops = sorted(tuple(r) for r in own.groupBy("part").agg(F.max(F.struct("k", "tie")).alias("top")).select("part", "top.k", "top.tie").collect())
    places = spark.createDataFrame([(*t, tops[(i + 1) % len(tops)][0]) for i, t in enumerate(tops)], "part int, k long, tie long, host int")
    dealt = own.join(F.broadcast(places), ["part", "k", "tie"], "left")
    here, there = F.struct(F.col("part").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("at"), F.lit(True).alias("guest"))
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("host").isNull(), F.array(here)).otherwise(F.array(here, there)))).select("doc_id", "text", "k", "tie", "to.at", "to.guest")
    dealt = dealt.repartition(max(shuffles(spark), -(-size // TASK_BYTES)), "at").withColumn("fp", fingerprint(F.col("text")))
    after = Window.partitionBy("at").orderBy("guest", F.desc("k"), F.desc("tie"), F.desc("text"))
    return dealt.withColumns({"next_text": F.lead("text").over(after), "next_fp": F.lead("fp").over(after)}).where("not guest").select("doc_id", "text", "fp", "next_text", "next_fp")


def edited(rows: DataFrame) -> DataFrame:
    """Rows of ``with_next`` with ``edited``, the text with its last floor(n / 2) code points replaced by as many (or all) of the next one's first, and ``edited_fp``."""
    rows = rows.withColumn("n_chars", F.length("text")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("second", F.substring("next_text", F.lit(1), F.col("half")))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - F.col("half")), "second"))
    a, b = F.col("n_chars") - F.col("half"), F.length("second")
    rows = rows.withColumn("across", fingerprint(joint(F.col("edited"), a, b)))
    return rows.withColumn("edited_fp", spliced(F.col("fp"), a, F.col("next_fp"), b, F.col("across"))).drop("half", "second", "across")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, the SHA-256 of the edited text, both fingerprints, and how alike they and the next document's are."""
    rows = edited(with_next(docs))
    rows = rows.withColumns({"h": hashes(F.col("fp")), "eh": hashes(F.col("edited_fp")), "nh": hashes(F.col("next_fp"))})
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("fp")).alias("fingerprint"),
        written(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("eh")).alias("near_edited"),
        likeness(F.col("h"), F.col("nh")).alias("near_next"),
    )
