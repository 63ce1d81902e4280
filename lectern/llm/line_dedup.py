"""Fuzzy line deduplication: sketches of normalised lines, pigeonhole join of their blocks, edit similarity, one occurrence a group.

A line is normalised to lower case with every run of other characters than
letters and digits as one space. Two lines link when at most d words are put
in, taken out or replaced, the order of words counting, where d is a tenth of
the longer's ``n`` words, rounded (``(n + 5) div 10``), and ``MOST`` at most.
Of all occurrences of the lines of a connected group the first stays, by
document id and line number. Lines without letters and digits always stay.

Every word belongs to one of 2d + 1 blocks by its hash, wherever it stands. One
edit touches two blocks at most, so after d edits one block holds the same
words: lines meet under the hash of each block's words. A line whose partner
may allow one edit more sends keys for 2d + 3 blocks, too. So no link is lost.

Blocks of few words, and keys that a sample shows to be frequent, say too little.
Outside such a block d edits leave all but d words in common, so of the first
d + k words there, in one fixed order of all words (long ones first), lines share
k: they meet under the block with each k of those words instead. (Of a line the
first ``RARE`` words are kept; that a block holds so many of them that d + k
others are not there has a chance below 1e-5.) Before texts are looked at, a parity sketch of 64 bits, in which every word turns one bit and
an edit two at most, rules out lines that merely share a key. Where many lines of one
family still fall apart, four more such sketches and the edits themselves are looked at as they meet.

Everything is DataFrame operations. Equal lines are known by two 64-bit hashes;
lines that share only one of them are left alone. Edits are counted on strings
of one code point a word, out of a million, so a pair that is one edit too far
passes with a chance of some 1e-6.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_IDS, discard, keep_ids, stored
from lectern.llm.components import connected_components

#: Edited words allowed: (words + 5) div TENTH, and MOST at most.
TENTH, MOST = 10, 3
#: Words that a block must hold to be a key by itself.
LEAST = 3
#: Words outside a block that a finer key takes.
FEW = 2
#: Words of a line that are kept for finer keys.
RARE = 14
#: A key found this often among a sixteenth of the lines is frequent, or, if it is a finer one, dealt over several tasks.
HOT = 16
#: Lines of a key that go to one task.
SLICE = 4096
#: Code points that stand for words.
CODES = 1_000_000

_RUN = r" [^\p{L}\p{N}\n]+|[^\p{L}\p{N}\n ][^\p{L}\p{N}\n]*"
_ROW = ["doc_id", "row", "line_no"]


def normalised(text: Column) -> Column:
    """Lower case, every run of other characters than letters, digits and line breaks as one space."""
    return F.regexp_replace(F.lower(text), _RUN, " ")


def allowed(a: str | Column, b: str | Column) -> Column:
    n = F.greatest(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
    return F.least(F.floor((n + 5) / TENTH), F.lit(MOST)).cast("int")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


#: Of a word's hash: the bits that say its block and order. Of a block's hash: how many bits stand below its number of words.
PLACED, HASHED = (1 << 31) - 1, 48
#: Bits of a word below those of its block.
_BELOW = 60


def _blocks(placed: Column, k: Column) -> Column:
    """Of each of ``k`` blocks how many words it holds, above a hash of them; ``placed`` holds its words in ascending order, a mark before each block."""
    at = lambda b: F.array_position(placed, F.lit(b << _BELOW)).cast("int")

    def block(b: int) -> Column:
        size = at(b + 1) - at(b) - 1
        return F.shiftleft(size.cast("long"), HASHED).bitwiseOR(F.xxhash64(F.slice(placed, at(b) + 1, size)).bitwiseAND(F.lit((1 << HASHED) - 1)))

    return F.slice(F.array(*[F.when(F.lit(b) < k, block(b)) for b in range(2 * MOST + 1)]), 1, k)


def sketched(lines: DataFrame) -> DataFrame:
    """``id, n, sketch, rare, own, next`` of normalised lines ``id, line``: words, parity sketch, hashes of its first words in the fixed order, hashes of blocks for the edits that it allows and, where a partner may allow one more, for one more (else empty).

    Sorting and cutting are functions over whole arrays, which Spark compiles; those with a body for each element it does not.
    """
    nothing = F.array().cast("array<bigint>")
    marks = F.array(*[F.lit(b << _BELOW) for b in range(2 * MOST + 2)])
    order = F.transform(F.split("line", " "), lambda w: F.xxhash64(w).bitwiseAND(F.lit(PLACED)) - F.shiftleft(F.least(F.length(w) + F.when(w < ":", 16).otherwise(0), F.lit(24)).cast("long"), 32))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x.bitwiseAND(F.lit(PLACED)), 25).cast("int"))
    place = lambda k: F.transform("words", lambda x: F.shiftleft(F.pmod(x.bitwiseAND(F.lit(PLACED)), k), _BELOW).bitwiseOR(x.bitwiseAND(F.lit((1 << _BELOW) - 1))))
    made = lines.select("id", F.sort_array(order).alias("words")).withColumn("n", F.size("words"))
    made = made.withColumn("d", allowed("n", "n")).withColumn("more", (F.col("d") < MOST) & (F.col("n") + F.col("d") + 1 >= TENTH * (F.col("d") + 1) - 5))
    sketch = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x)))
    rare = F.transform(F.slice("words", 1, RARE), lambda x: x.bitwiseAND(F.lit(PLACED)).cast("int"))
    for name, used, k in (("own", F.col("d") > 0, F.col("d") * 2 + 1), ("next", F.col("more"), F.col("d") * 2 + 3)):
        made = made.withColumn(f"{name}_placed", F.when(used, F.sort_array(F.concat(place(k), marks)))).withColumn(name, F.when(used, _blocks(F.col(f"{name}_placed"), k)).otherwise(nothing))
    return made.select("id", "n", sketch.alias("sketch"), rare.alias("rare"), "own", "next")


def _subsets(words: Column, k: int) -> Column:
    """Hashes of all ``k`` (2 at most) of the words, which are in the fixed order."""
    if k < 2:
        return F.transform(words, lambda a: F.xxhash64(a)) if k else F.array(F.lit(0).cast("long"))
    return F.flatten(F.transform(words, lambda a, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda b: F.xxhash64(a, b))))


def finer(key: str, rare: Column, d: Column, outside: Column, k: int) -> Column:
    """Keys under which lines meet that share ``key`` and are d edits apart: with each ``k`` of the first d + k words outside its block; lines of fewer words also with fewer."""
    out = []
    for few in range(k, -1, -1):
        own = F.slice(rare, 1, F.least(d + few, F.size(rare)))
        keys = F.transform(_subsets(own, few), lambda x: F.xxhash64(F.col(key), F.lit(few), x))  # noqa: B023
        out.append(keys if few == k else F.when(outside < d + few + 1, keys).otherwise(F.array().cast("array<bigint>")))
    return F.array_distinct(F.concat(*out))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``row``, ``text`` of rows with both; of rows repeated with id and text, one."""
    own = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    twice = own.groupBy("doc_id").count().where("count > 1")
    if not twice.limit(1).count():
        return own.select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    once = keep_ids(own, twice, "doc_id", "left_anti").unionByName(keep_ids(own, twice, "doc_id").dropDuplicates())
    return once.select("doc_id", F.xxhash64("text").alias("row"), "text")


def _lines(rows: DataFrame) -> DataFrame:
    """Every line with letters or digits, normalised, and where it stands."""
    lines = rows.select("doc_id", "row", F.posexplode(F.split(normalised(F.col("text")), "\n", -1)).alias("line_no", "line"))
    return lines.select(*_ROW, F.trim("line").alias("line")).where("line <> ''")


def _sketches(rows: DataFrame, seen: DataFrame, first: DataFrame) -> DataFrame:
    """``id``, ``often`` and what ``sketched`` says of every different line, from its first occurrence."""
    later = seen.join(first.select("id", "at"), "id").where(F.struct(*_ROW) != F.col("at")).select(F.xxhash64(*_ROW).alias("spot"))
    own = keep_ids(_lines(rows).withColumn("spot", F.xxhash64(*_ROW)), stored(later, "later-lines"), "spot", "left_anti")
    made = sketched(own.select(F.xxhash64("line").alias("id"), "line"))
    often = stored(first.where("often > 1").select("id", F.least("often", F.lit(1 << 30)).cast("int").alias("often")), "often")
    made = made.join(F.broadcast(often) if often.count() <= BROADCAST_IDS else often, "id", "left")
    return stored(made.withColumn("often", F.coalesce("often", F.lit(1))), "sketches")


def _never_empty(keys: DataFrame, *others: Column) -> DataFrame:
    """With a key that no line has, so that plans are the same whether there are frequent keys or not."""
    return keys.unionByName(keys.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"), *others))


def _keyed(sketches: DataFrame) -> DataFrame:
    """``key, id, n, sketch, often`` of every line under each of its keys, those of small and frequent blocks being finer ones."""
    own = allowed("n", "n")
    named = lambda sums, d: F.transform(sums, lambda s, i: F.struct(d.alias("d"), i.alias("block"), s.alias("sum")))
    lines = sketches.select("id", "n", "sketch", "often", "rare", F.explode(F.concat(named("own", own), named("next", own + 1))).alias("x")).select("id", "n", "sketch", "often", "rare", "x.*")
    blocks = lines.withColumn("key", F.xxhash64("d", "block", "sum")).withColumn("size", F.shiftrightunsigned("sum", HASHED).cast("int"))
    small = F.col("size") < LEAST
    hot = blocks.where(~small & (F.pmod("id", F.lit(16)) == 0)).groupBy("key").count().where(F.col("count") >= HOT).select("key", F.lit(True).alias("hot"))
    hot = stored(_never_empty(hot, F.lit(True).alias("hot")), "hot-blocks")
    marked = blocks.join(F.broadcast(hot) if hot.count() <= BROADCAST_IDS // 2 else hot, "key", "left")
    outside = F.filter("rare", lambda w: F.pmod(w, F.col("d") * 2 + 1) != F.col("block"))
    by = _let(outside, lambda o: finer("key", o, F.col("d"), F.col("n") - F.col("size"), FEW))
    keys = F.when(small | F.coalesce("hot", F.lit(False)), by).otherwise(F.array("key"))
    return marked.select(F.explode(keys).alias("key"), "id", "n", "sketch", "often")


def coded(line: Column) -> Column:
    """A string of one code point a word."""
    code = lambda w: F.lpad(F.hex(F.lit(65536) + F.pmod(F.xxhash64(w), F.lit(CODES))), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(F.split(line, " "), code), "")), "UTF-32")


def _codes(ids: DataFrame, first: DataFrame, rows: DataFrame) -> DataFrame:
    """``id, code`` of the lines ``ids``; texts come from each line's first occurrence.

    Rows of text are read again where they stand: only lines asked for are
    normalised and go on, found by a broadcast of their places while these are
    counted to be few, else by a join.
    """
    spot = F.xxhash64(*_ROW).alias("spot")
    needed = stored(ids.join(first, "id").select("id", "at.*").select("id", *_ROW, spot), "line-places")
    n = needed.count()
    raw = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select(*_ROW, "line", spot)
    if n <= BROADCAST_IDS:
        raw = raw.join(F.broadcast(needed.select("spot")), "spot", "left_semi")
    found = raw.drop("spot").join(needed.drop("spot"), _ROW).select("id", F.trim(normalised(F.col("line"))).alias("line"))
    out = stored(found.select("id", coded(F.col("line")).alias("code")), "line-codes")
    discard(needed)
    return out


def _within(a: str, b: str) -> Column:
    """Whether two lines' codes are within the edits allowed."""
    return F.expr(f"levenshtein({a}, {b}, cast(least((greatest(length({a}), length({b})) + 5) div {TENTH}, {MOST}) as int))") >= 0


#: More parity sketches of lines of keys that hold several components, and their columns.
MORE = [f"sketch_{k}" for k in range(4)]


def _sketched_again(codes: DataFrame) -> DataFrame:
    """``codes`` with ``MORE``: lines of one family are many under each key, and a few edits more than allowed often fit one sketch, hardly five."""
    hashed = codes.withColumn("__words", F.transform(F.split("code", ""), lambda c: F.xxhash64(c)))
    bit = lambda h, k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    sketch = lambda k: F.aggregate("__words", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h, k)))
    return hashed.withColumns({c: sketch(k) for k, c in enumerate(MORE)}).drop("__words")


def _verified(pairs: DataFrame, first: DataFrame, rows: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) those within the edits allowed."""
    lines = _codes(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), first, rows)
    side = lambda k: lines.select(F.col("id").alias(k), F.col("code").alias(f"code_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    out = stored(both.where(_within("code_a", "code_b")).select("a", "b"), "line-links")
    discard(lines)
    return out


def _links(sketches: DataFrame, first: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) that connect the lines of each group, over the different lines ``first``.

    The lines of a key are first held against the most frequent. Where they still
    fall apart, those outside the key's largest component are held against all
    of the key's other components. Keys of very many lines are
    known from a sixteenth of the lines, with a line to hold against; theirs are
    dealt over tasks by ``SLICE``.
    """

    def near(x: str, y: str, *more: str) -> Column:
        d = allowed(f"{x}n", f"{y}n")
        alike = F.abs(F.col(f"{x}n") - F.col(f"{y}n")) <= d
        for c in ("sketch", *more):
            alike &= F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) <= 2 * d
        return alike

    mine = ["id", "n", "sketch"]
    keyed = _keyed(sketches)
    own = Window.partitionBy("key", "slice")
    sample = keyed.where(F.pmod("id", F.lit(16)) == 0).groupBy("key").agg(F.count("*").alias("count"), F.max(F.struct("often", *mine)).alias("hot")).where(F.col("count") >= HOT)
    sample = sample.select("key", "hot", F.ceil(F.col("count") * 16 / SLICE).cast("int").alias("slices"))
    nobody = F.lit(None).cast(sample.schema["hot"].dataType).alias("hot")
    hot = stored(_never_empty(sample, nobody, F.lit(1).alias("slices")), "hot-keys")
    dealt = keyed.join(F.broadcast(hot) if hot.count() <= BROADCAST_IDS // 8 else hot, "key", "left").withColumn("slice", F.when(F.col("slices").isNull(), 0).otherwise(F.pmod("id", F.col("slices"))))
    dealt = dealt.withColumn("top", F.max(F.struct("often", *mine)).over(own)).withColumn("several", F.min("id").over(own) < F.max("id").over(own)).where("several or hot is not null")
    head = lambda c: F.coalesce(F.col("hot")[c], F.col("top")[c]).alias(f"head_{c}")
    members = stored(dealt.select("key", *mine, *map(head, mine)), "line-keys")
    stars = members.where((F.col("id") != F.col("head_id")) & near("", "head_")).select(F.col("head_id").alias("a"), F.col("id").alias("b"))
    stars = stored(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    links = _verified(stars, first, rows)
    placed = members.join(connected_components(links).withColumnRenamed("node", "id"), "id", "left").select("key", *mine, F.coalesce("component", "id").alias("component"))
    placed = stored(placed, "placed-lines")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("lines"))
    largest = F.max_by("component", F.shiftleft("lines", 32).bitwiseOR(F.col("component").bitwiseAND(F.lit((1 << 32) - 1))))
    most = sizes.groupBy("key").agg(largest.alias("most"), F.count("*").alias("parts"), F.ceil(F.sum("lines") / SLICE).cast("int").alias("slices")).where("parts > 1")
    most = stored(most.select("key", "most", "slices"), "mixed-keys")
    if not most.limit(1).count():
        discard(hot, members, placed, most, stars)
        return links
    crowd_lines = stored(placed.join(F.broadcast(most) if most.count() <= BROADCAST_IDS // 4 else most, "key"), "crowded-lines")
    codes = _codes(crowd_lines.select("id").distinct(), first, rows)
    crowd = crowd_lines.join(_sketched_again(codes), "id")
    x = crowd.where("component <> most").select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).alias("x")
    y = crowd.withColumn("slice", F.pmod("id", F.col("slices")).cast("int")).alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.most")) | (F.col("x.id") < F.col("y.id")))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.slice") == F.col("y.slice")) & near("x.", "y.", *MORE) & apart & _within("x.code", "y.code"))
    further = stored(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "line-links")
    discard(hot, members, placed, most, stars, crowd_lines, codes)
    return links.union(further)


def removed_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``row``, ``n_lines`` (with letters or digits), ``removed`` (their numbers from 0) for every row with such a line.

    ``row`` is 0 where ids are unique, else the hash of the row's text.
    """
    rows = _rows(docs, doc_id, text)
    seen = stored(_lines(rows).select(*_ROW, F.xxhash64("line").alias("id"), F.xxhash64(F.lit(7), "line").alias("id2")), "lines")
    first = stored(seen.groupBy("id").agg(F.count("*").alias("often"), (F.min("id2") == F.max("id2")).alias("sole"), F.min(F.struct(*_ROW)).alias("at")), "first-lines")
    links = _links(_sketches(rows, seen, first), first.where("sole"), rows)
    component = connected_components(links).withColumnRenamed("node", "id")
    grouped = first.where("sole").select("id", "at", "often").join(component, "id", "left").where("often > 1 or component is not null").withColumn("component", F.coalesce("component", "id"))
    stay = grouped.groupBy("component").agg(F.min("at").alias("stay"))
    decided = stored(grouped.join(stay, "component").select("id", "stay"), "line-groups")
    few = decided.count() <= BROADCAST_IDS // 2
    gone = seen.select(*_ROW, "id").join(F.broadcast(decided) if few else decided, "id", "left")
    return gone.groupBy("doc_id", "row").agg(F.count("*").alias("n_lines"), F.collect_list(F.when(F.struct(*_ROW) != F.col("stay"), F.col("line_no"))).alias("removed"))


def _kept(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with ``name``: the text without the lines ``removed``; as it is where these are null or none."""
    parts = docs.withColumn("__parts", F.when(F.size("removed") > 0, F.split(text, "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("removed"))
    kept = F.array_join(F.transform(stay, lambda i: F.col("__parts")[i]), "\n")
    return parts.withColumn(name, F.when(F.col("__parts").isNull(), F.col(text)).otherwise(kept)).drop("__parts")


def _with_removed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with ``n_lines`` and ``removed``, null where a row has no line with letters or digits."""
    found = removed_lines(docs, doc_id=doc_id, text=text).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "n_lines", "removed")
    same = (F.col(doc_id) == F.col("__id")) & ((F.col("__row") == 0) | (F.col("__row") == F.xxhash64(text)))
    return docs.join(found, same, "left").drop("__id", "__row")


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", drop_emptied: bool = True) -> DataFrame:
    """``docs`` with all but the first occurrence of each group of lines cut out of ``text``.

    A document whose lines with letters or digits were all removed goes, unless
    ``drop_emptied`` is false. Null texts and ids, and texts without such
    lines, pass unchanged. Rows with one id and different texts are told apart
    and ordered by a hash of the text; rows repeated with id and text are one
    occurrence and all keep its lines. Other columns pass through, whatever
    their names.
    """
    column = lambda c: F.col(f"`{c}`")
    own = docs.select(F.struct(*map(column, docs.columns)).alias("__own"), column(doc_id).alias("__doc"), column(text).alias("__text"))
    out = _with_removed(own, "__doc", "__text")
    if drop_emptied:
        out = out.where(F.col("removed").isNull() | (F.size("removed") < F.col("n_lines")))
    out = _kept(out, "__text", "__kept")
    return out.select(*[F.col("__kept").alias(c) if c == text else F.col("__own")[c].alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id``, ``n_lines`` and ``n_removed`` (of lines with letters or digits) and the SHA-256 of what is left."""
    out = _kept(_with_removed(docs.select("doc_id", "text"), "doc_id", "text"), "text", "kept")
    n = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"), F.greatest(n, F.lit(0).cast("long")).alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
