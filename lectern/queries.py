"""Queries over the document operators, and their SQL.

Inputs the driver's tables lack (layout, captions, tokens, contents) are
derived from them by the same arithmetic on both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import filters as f
from lectern.functions import text as t
from lectern.functions import tokens as k
from lectern.operators import blocks as b
from lectern.operators import chunks, formulas, lines, overlay, recognise, rules, sections, tables, toc
from lectern.operators.islands import settled

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(q: Query) -> Query:
        _QUERIES[q.__name__] = q
        if sql:
            _SQL[q.__name__] = sql.strip()
        return q

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived inputs


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


LINES = "l AS (SELECT doc_id, unnest(range(0, len(s))) AS line_no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a line of a page with 20 lines, whole-numbered places and sizes."""
    return doc_lines(spark, sf_dir).selectExpr(
        "doc_id", "line_no", "cast(floor(line_no / 20) as int) + 1 as page",
        "cast(case when (doc_id * 7 + line_no * 13) % 17 = 0 then 140 when (doc_id + line_no) % 9 = 0 then 100 else 72 end as double) as x",
        "cast(60 + cast(line_no % 20 as int) * 12 + case when line_no % 20 >= 10 then 30 else 0 end as double) as y",
        "cast(case when (doc_id + line_no * 5) % 11 = 0 then 18 when (doc_id + line_no) % 13 = 0 then 14 else 11 end as double) as avg_size",
        "cast(case when (doc_id + line_no) % 13 = 0 then 1 else 0 end as double) as bold_ratio", "text", "595D as page_w", "842D as page_h",
    )


LAYOUT = f"""{LINES}, layout AS (
SELECT doc_id, line_no, CAST(floor(line_no / 20) AS INT) + 1 AS page,
  CASE WHEN (doc_id * 7 + line_no * 13) % 17 = 0 THEN 140 WHEN (doc_id + line_no) % 9 = 0 THEN 100 ELSE 72 END AS x,
  60 + CAST(line_no % 20 AS INT) * 12 + CASE WHEN line_no % 20 >= 10 THEN 30 ELSE 0 END AS y,
  CASE WHEN (doc_id + line_no * 5) % 11 = 0 THEN 18 WHEN (doc_id + line_no) % 13 = 0 THEN 14 ELSE 11 END AS avg_size,
  CASE WHEN (doc_id + line_no) % 13 = 0 THEN 1 ELSE 0 END AS bold_ratio, text FROM l)"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_quantity as int) as q", "element_at(array('cm', 'kg', 'm', 'ml'), l_linenumber % 4 + 1) as unit")


def toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of layout lines that begin with a table of contents: a title and the first 12 words of each line with its number."""
    return doc_lines(spark, sf_dir).selectExpr("doc_id", "line_no", "case when line_no = 1 then 'Contents' when line_no between 2 and 8 then concat('Part ', line_no, ' ', line_no) else text end as text")


TOC = f"{LINES}, toc AS (SELECT doc_id, line_no, CASE WHEN line_no = 1 THEN 'Contents' WHEN line_no BETWEEN 2 AND 8 THEN 'Part ' || line_no || ' ' || line_no ELSE text END AS text FROM l)"

# SQL forms of the text functions, for texts whose white space is ASCII
WS = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def ws(c: str) -> str:
    return WS.format(c)


# --- text functions


@query(f"SELECT doc_id, {ws('text')} AS text FROM documents")
def ws_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.normalize_ws(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g') AS text FROM documents")
def control_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.strip_control_chars(F.col("text")).alias("text"))


@query("SELECT doc_id, " + ws(r"regexp_replace(replace(text, '. ', '.....'), '\.{5,}', ' ', 'g')") + " AS text FROM documents")
def dot_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.remove_dot_leaders(F.replace("text", F.lit(". "), F.lit("....."))).alias("text"))


@query(r"SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.' || l_linenumber AS text FROM lineitem")
def decimal_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat(cast(l_quantity as int), ' . ', l_linenumber) as text")
    return rows.withColumn("text", t.fix_decimal_spacing(F.col("text")))


@query(r"SELECT l_orderkey, l_linenumber, 'Rows ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' to ' || l_linenumber || ' of a-b' AS text FROM lineitem")
def numeric_range_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat('Rows ', cast(l_quantity as int), element_at(array(' - ', '-', ' – ', '—'), l_linenumber % 4 + 1), l_linenumber, ' of a-b') as text")
    return rows.withColumn("text", t.normalize_numeric_ranges(F.col("text")))


POINT = r"regexp_replace({0}, '([0-9])\.([0-9])', '\1 point \2', 'g')"


@query(f"SELECT doc_id, {ws(POINT.format(POINT.format('text')))} AS text FROM documents")
def dots_to_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.normalize_dots(F.col("text")).alias("text"))


@query("SELECT c_custkey, 'See www.x.org slash ' || c_custkey || '; slash data slash ' || c_nationkey || ' and a per b, ' || c_nationkey || ' upon 4' AS text FROM customer")
def slash_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('See www.x.org/', c_custkey, '; /data/', c_nationkey, ' and a / b, ', c_nationkey, ' / 4') as text")
    spoken = t.normalize_ws(t.normalize_slash_context(F.col("text")))
    return rows.withColumn("text", spoken)


UNIT_CASE = "CASE l_linenumber % 4 WHEN 0 THEN 'centimetre' WHEN 1 THEN 'kilogram' WHEN 2 THEN 'metre' ELSE 'millilitre' END"


@query(f"SELECT l_orderkey, l_linenumber, 'Length ' || CAST(l_quantity AS INT) || ' ' || {UNIT_CASE} || CASE WHEN CAST(l_quantity AS INT) = 1 THEN '' ELSE 's' END || ' of stock.' AS text FROM lineitem")
def unit_pluralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measurements(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", t.normalize_units(F.concat(F.lit("Length "), F.col("q").cast("string"), F.lit(" "), F.col("unit"), F.lit(" of stock."))).alias("text"))


@query(
    "SELECT l_orderkey, l_linenumber, 'Room ' || CAST(l_quantity AS INT) || CASE l_linenumber % 2 WHEN 0 THEN ' square' ELSE ' cubic' END || ' metre' || CASE WHEN CAST(l_quantity AS INT) = 1 THEN '' ELSE 's' END AS text FROM lineitem"
)
def unit_area_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measurements(spark, sf_dir)
    made = F.concat(F.lit("Room "), F.col("q").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " m2").otherwise(" m^3"))
    return rows.select("l_orderkey", "l_linenumber", t.normalize_units(made).alias("text"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) || '.5 millilitres' AS text FROM lineitem")
def decimal_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).select("l_orderkey", "l_linenumber", t.normalize_units(F.concat(F.col("q").cast("string"), F.lit(",5 ml"))).alias("text"))


@query("SELECT page_id, " + ws("regexp_replace(html, '<[^>]+>', ' ', 'g')") + " AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.clean_for_tts(F.col("html")).alias("text"))


ABBREVIATED = r"regexp_replace({0}, '(?i)(^|[^0-9A-Za-z_À-ÿ])(mr|mrs|ms|dr|prof|sr|jr|e\.g|i\.e|etc|vs|no|fig|eq|inc|ltd|pvt|co|dept|gov)\.', '\1\2' || chr(57344), 'g')"
SENTENCES = "list_filter(list_transform(string_split(regexp_replace(" + ABBREVIATED + r", '([.?!])\s+', '\1' || chr(57345), 'g'), chr(57345)), lambda x: trim(regexp_replace(replace(x, chr(57344), '.'), '\s+', ' ', 'g'))), lambda x: x <> '')"


@query(f"SELECT conv_id, turn, unnest(range(1, len(s) + 1)) AS sentence_no, unnest(s) AS sentence FROM (SELECT conv_id, turn, {SENTENCES.format('text')} AS s FROM conversations)")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(t.split_sentences(F.col("text"))).alias("n", "sentence"))
    return rows.select("conv_id", "turn", (F.col("n") + 1).cast("long").alias("sentence_no"), "sentence")


ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"SELECT doc_id, '<speak>' || chr(10) || {ESCAPED.format('array_to_string(s, chr(32))')} || '<break time=\"350ms\"/>' || chr(10) || '</speak>' AS ssml FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents WHERE trim(text) <> '')")
def ssml_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(t.strip(F.col("text")) != "").select("doc_id", t.text_ssml(F.col("text")).alias("ssml"))


@query(
    r"""WITH marked AS (SELECT conv_id, turn, regexp_replace(text, '([\p{L}\p{M}\p{N}_]+)', chr(1) || '\1' || chr(1), 'g') AS t FROM conversations)
SELECT conv_id, turn, replace(regexp_replace(regexp_replace(t, '(?i)\x01the\x01', 'T H E', 'g'), '(?i)\x01of\x01', 'o f', 'g'), chr(1), '') AS text FROM marked"""
)
def dictionary_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [{"find": "the", "replace": "T H E", "match_type": "word"}, {"find": "of", "replace": "o f", "match_type": "word"}, {"find": "a", "replace": "b", "enabled": False}]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.apply_dictionary(F.col("text"), rules).alias("text"))


def _benchmark_words(spark: SparkSession, sf_dir: str, word: str) -> DataFrame:
    """``find, position``: the different matches of ``word`` in ``benchmark``, by length and alphabet."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(word), F.lit(0))).alias("find")).distinct()
    return words.withColumn("position", F.row_number().over(Window.orderBy(F.length("find"), F.col("find"))))


WORD = r"[\p{L}\p{M}\p{N}_]+"
ALL_WORDS = f"SELECT find, row_number() OVER (ORDER BY length(find), find) AS position FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS find FROM benchmark)"
RULE_WORDS = "SELECT find, row_number() OVER (ORDER BY length(find), find) AS position FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS find FROM benchmark) WHERE length(find) >= {}"


@query(
    f"WITH r AS ({ALL_WORDS}), a AS (SELECT list(find || chr(1) || substr(find, 2) || position ORDER BY position) AS rules FROM r) "
    "SELECT doc_id, sha256(list_reduce(list_prepend(text, rules), lambda t, x: replace(t, split_part(x, chr(1), 1), split_part(x, chr(1), 2)))) AS text_sha256 FROM documents, a"
)
def rule_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark as a rule, of any length and letters; what one rule puts in, a later one may find."""
    words = _benchmark_words(spark, sf_dir, WORD)
    own = words.select("position", "find", F.concat(F.expr("substr(find, 2)"), F.col("position").cast("string")).alias("replace"), F.lit(True).alias("case_sensitive"))
    out = rules.replace_by_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), own)
    return out.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query(
    f"WITH {LINES}, r AS ({RULE_WORDS.format(9)}), t AS (SELECT doc_id, line_no, trim(text, ' ' || chr(9)) AS t FROM l), firsts AS (SELECT DISTINCT t FROM t WHERE line_no = 0) "
    "SELECT doc_id, line_no FROM t WHERE t = '' OR (t NOT IN (SELECT t FROM firsts) AND NOT EXISTS (SELECT 1 FROM r WHERE contains(lower(t), lower(find))))"
)
def rule_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no document's first line and hold no long word of the benchmark: exact and pattern rules from tables."""
    found = doc_lines(spark, sf_dir)
    exact = found.where("line_no = 0").select(F.lit(0).alias("position"), t.strip(F.col("text")).alias("find"), F.lit("exact").alias("match_type")).distinct()
    patterns = _benchmark_words(spark, sf_dir, "[A-Za-z]{9,}").select("position", F.concat(F.lit("(?:"), "find", F.lit(")[a-z]*")).alias("find"), F.lit("regex").alias("match_type"))
    return rules.drop_by_rules(found, exact.unionByName(patterns)).select("doc_id", "line_no")


@query(
    r"""WITH cut AS (SELECT conv_id, turn, regexp_replace(replace(text, ' the', '-' || chr(10) || ' the'), '([\p{L}\p{M}\p{N}_])-\s*\n\s*([\p{L}\p{M}\p{N}_])', '\1\2', 'g') AS text FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '([,.;:!?])([A-Za-z])', '\1 \2', 'g'), chr(10) || ' ') AS text FROM cut"""
)
def selection_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with lines that are cut at hyphens."""
    cut = F.replace(F.col("text"), F.lit(" the"), F.lit("-\n the"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.normalize_selection(cut).alias("text"))


@query(r"""SELECT conv_id, turn, '<speak><s>' || replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(10), ' ') || '</s></speak>' AS ssml FROM conversations""")
def selection_ssml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.selection_ssml(F.col("text")).alias("ssml"))


@query(r"SELECT doc_id, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s_]+', '', 'g'), '\s+', '_', 'g'), '_'), 1, 60), ''), 'section') AS slug FROM documents")
def title_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.slug(F.col("text")).alias("slug"))


# --- lines and furniture


@query(f"WITH {LINES} SELECT doc_id, line_no, text FROM l")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir)


@query(r"""SELECT doc_id, n AS line_no, text FROM (SELECT doc_id, l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN 'page ' || l_linenumber WHEN 1 THEN l_linenumber || ' of 7' WHEN 2 THEN 'xiv' ELSE 'Line ' || l_linenumber END AS text FROM lineitem JOIN documents ON l_orderkey = doc_id) WHERE text LIKE 'Line%'""")
def page_marker_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "documents"), F.col("l_orderkey") == F.col("doc_id"))
    rows = rows.selectExpr("doc_id", "l_linenumber as line_no", "case l_linenumber % 4 when 0 then concat('page ', l_linenumber) when 1 then concat(l_linenumber, ' of 7') when 2 then 'xiv' else concat('Line ', l_linenumber) end as text")
    return rows.where(~f.page_marker(F.col("text")))


@query(f"WITH {LINES} SELECT doc_id, line_no, text FROM l WHERE NOT regexp_matches(lower(text), 'for bis use only|copyright protected document|all rights reserved|© iso|published in switzerland')")
def boilerplate_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).where(~f.boilerplate(F.col("text")))


@query(f"WITH {LAYOUT} SELECT doc_id, line_no, page, y FROM layout WHERE NOT (avg_size - 3 <= 9 AND (y <= 72 - 37 OR x + 440 >= 540)) AND NOT (y <= 842 * 0.04 OR y >= 842 * 0.96)")
def margin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout(spark, sf_dir)
    rows = rows.where(~f.margin_noise(F.col("x") + 440, F.col("y"), F.col("avg_size") - 3) & ~f.header_or_footer(F.col("y"), F.col("y") + 0, F.col("page_h")))
    return rows.select("doc_id", "line_no", "page", F.col("y").cast("int").alias("y"))


@query(f"WITH {LINES}, n AS (SELECT doc_id, count(*) AS lines FROM l GROUP BY doc_id) SELECT doc_id, sum(length(text)) AS chars, sum(length(text)) < 200 AS scanned FROM l GROUP BY doc_id")
def scanned_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.scanned(doc_lines(spark, sf_dir)).select("doc_id", F.col("chars").cast("decimal(38,0)").alias("chars"), "scanned")


REPEATED = f"""{LINES}, x AS (SELECT hash AS doc_id, doc_id AS page, text FROM (SELECT CAST(substr(source, 4) AS BIGINT) AS hash, doc_id, l.text FROM l JOIN (SELECT doc_id, source FROM documents) USING (doc_id))),
pages AS (SELECT doc_id, count(DISTINCT page) AS pages FROM x GROUP BY doc_id),
repeated AS (SELECT x.doc_id, text FROM x JOIN pages USING (doc_id) WHERE length(text) <= 200 GROUP BY x.doc_id, text, pages
  HAVING count(*) >= 0.02 * pages AND (length(text) >= 25 OR regexp_matches(lower(text), 'supplied by|under the license|license from bis|valid upto|book supply bureau|csir-national physical laboratory')))"""


def _source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source as a document, each of its documents as a page."""
    rows = table(spark, sf_dir, "documents").select(F.substring("source", 4, 9).cast("long").alias("source"), "doc_id", F.explode(F.split("text", "\n", -1)).alias("text"))
    return rows.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")


@query(f"WITH {REPEATED} SELECT doc_id, text FROM repeated")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated(_source_lines(spark, sf_dir), share=0.02)


@query(f"WITH {REPEATED} SELECT doc_id, page, text FROM x ANTI JOIN repeated USING (doc_id, text)")
def repeated_lines_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated(_source_lines(spark, sf_dir), share=0.02).select("doc_id", "page", "text")


HF = f"""{LAYOUT}, p AS (SELECT doc_id, max(page) AS pages FROM layout GROUP BY doc_id),
c AS (SELECT doc_id, CASE WHEN y <= 842 * 0.08 THEN 'TOP' WHEN y >= 842 * 0.3 THEN 'BOTTOM' END AS band, 'size ' || avg_size AS text, page FROM layout)"""


@query(
    f"WITH {HF} SELECT c.doc_id, band, text, count(DISTINCT page) AS pages_count, round(count(DISTINCT page) / pages, 2) AS pages_ratio, array_to_string(list_sort(list(page))[1:6], ', ') AS sample_pages "
    "FROM c JOIN p USING (doc_id) WHERE band IS NOT NULL GROUP BY c.doc_id, band, text, pages HAVING count(DISTINCT page) >= 0.6 * pages"
)
def header_footer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout(spark, sf_dir).withColumn("text", F.concat(F.lit("size "), F.col("avg_size").cast("int").cast("string")))
    return lines.header_footer_candidates(rows, bottom=0.3)


# --- blocks and sections

CLASSIFIED = f"""{LAYOUT}, body AS (SELECT doc_id, coalesce(avg(CASE WHEN avg_size BETWEEN 9 AND 13 THEN avg_size END), 11.0) AS body FROM layout GROUP BY doc_id),
classified AS (SELECT layout.*, body, CASE WHEN avg_size >= body * 1.5 OR (bold_ratio >= 0.6 AND avg_size >= body * 1.25) THEN 'heading' ELSE 'paragraph' END AS type FROM layout JOIN body USING (doc_id))"""


@query(f"WITH {CLASSIFIED} SELECT doc_id, body AS body_size FROM body")
def body_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.body_size(layout(spark, sf_dir))


@query(f"WITH {CLASSIFIED} SELECT doc_id, line_no, type FROM classified")
def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.classify(layout(spark, sf_dir)).select("doc_id", "line_no", "type")


BLOCKS = f"""{CLASSIFIED}, n AS (SELECT *, row_number() OVER w AS pos, lag(type) OVER w AS t0, lag(page) OVER w AS p0, y - lag(y) OVER w AS dy, abs(x - lag(x) OVER w) AS dx FROM classified WINDOW w AS (PARTITION BY doc_id ORDER BY page, y, x, line_no)),
s AS (SELECT *, t0 IS NULL OR t0 <> type OR p0 <> page OR dy > 18 OR dx > 35 AS starts FROM n),
g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS block_no, {ws('text')} AS clean FROM s),
blocks AS (SELECT doc_id, block_no, min_by(type, pos) AS type, min_by(page, pos) AS page, count(*) AS n_lines,
  trim(string_agg(CASE WHEN starts THEN clean WHEN dy > 10 THEN chr(10) || clean ELSE ' ' || clean END, '' ORDER BY pos), ' ' || chr(10)) AS text FROM g GROUP BY doc_id, block_no)"""


@query(f"WITH {BLOCKS} SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, type, page, n_lines, text FROM blocks WHERE text <> ''")
def merge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.merge(layout(spark, sf_dir), reflowed=False).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "type", "page", "n_lines", "text")


@query()
def reflowed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.merge(layout(spark, sf_dir)).select("doc_id", "block_no", "type", "page", "n_lines", "text")


def heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks; headings by size get a number in front."""
    rows = b.classify(settled(layout(spark, sf_dir), "text", t.normalize_ws(F.col("text"))))
    text = F.when(F.col("type") == "heading", F.trim(F.concat_ws(" ", F.col("page").cast("string"), "text"))).otherwise(F.col("text"))
    return rows.select("doc_id", F.col("line_no").alias("block_no"), "type", "page", text.alias("text"))


HEADINGS = f"""{CLASSIFIED}, hb AS (SELECT doc_id, line_no AS block_no, type, page, {ws("CASE WHEN type = 'heading' THEN page || ' ' || text ELSE text END")} AS text FROM classified),
ok AS (SELECT *, type = 'heading' AND regexp_matches(text, '^[0-9]+(\\.[0-9]+)*\\s+.+$') AS head FROM hb WHERE text <> ''),
seqs AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY block_no) AS seq FROM ok),
sections AS (SELECT doc_id, seq, CASE WHEN seq = 0 THEN 1 ELSE min_by(page, block_no) END AS page_start, greatest(max(page), CASE WHEN seq = 0 THEN 1 ELSE 0 END) AS page_end,
  string_agg(text, chr(10) || chr(10) ORDER BY block_no) AS text, min_by(text, block_no) AS first FROM seqs GROUP BY doc_id, seq)"""
SECTION_NAMES = r"""CASE WHEN seq = 0 THEN 'Front matter' ELSE regexp_extract(first, '^([0-9]+(\.[0-9]+)*)\s+(.+)$', 1) || ' ' || regexp_extract(first, '^([0-9]+(\.[0-9]+)*)\s+(.+)$', 3) END AS title"""


@query(f"WITH {HEADINGS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS section_no, {SECTION_NAMES}, page_start, page_end, text FROM sections")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.build(heading_blocks(spark, sf_dir))
    return out.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "title", "page_start", "page_end", "text")


TABLED = HEADINGS.replace("hb AS (", "plain AS (").replace("ok AS (SELECT", "hb AS (SELECT * REPLACE (CASE WHEN block_no % 17 = 9 THEN 'table' ELSE type END AS type, CASE WHEN block_no % 17 = 9 THEN '[[TABLE|T' || block_no || '|Table ' || block_no || ']]' ELSE text END AS text) FROM plain WHERE text <> ''),\nok AS (SELECT", 1)
SECTION_ID = r"""CASE WHEN seq = 0 THEN '00_front_matter' ELSE regexp_extract(first, '^([0-9]+(\.[0-9]+)*)\s+(.+)$', 1) || '_' || substr(coalesce(nullif(trim(regexp_replace(regexp_replace(lower(regexp_extract(first, '^([0-9]+(\.[0-9]+)*)\s+(.+)$', 3)), '[^a-z0-9\s_]+', '', 'g'), '\s+', '_', 'g'), '_'), ''), 'section'), 1, 60) END"""


@query(
    f"WITH {TABLED}, tables AS (SELECT doc_id, seq, string_agg('T' || block_no || ' Table ' || block_no || ' ' || page, ';' ORDER BY block_no) AS tables, count(*) AS n FROM seqs WHERE type = 'table' GROUP BY ALL), "
    f"m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS section_no, {SECTION_ID} AS id, {SECTION_NAMES} FROM sections) "
    "SELECT doc_id, section_no, id, title, printf('%02d_%s.txt', section_no, id) AS file, page_start, page_end, len(regexp_extract_all(text, '\\S+')) AS word_count, coalesce(tables, '') AS tables, coalesce(n, 0) AS table_count FROM m LEFT JOIN tables USING (doc_id, seq)"
)
def section_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 17th line stands for a table."""
    here = F.col("block_no") % 17 == 9
    own = lambda *parts: F.when(here, F.concat(*parts))
    number = F.col("block_no").cast("string")
    rows = heading_blocks(spark, sf_dir).where("text <> ''").withColumn("type", F.when(here, "table").otherwise(F.col("type")))
    out = sections.manifest(sections.build(rows.withColumns({"table_id": own(F.lit("T"), number), "caption": own(F.lit("Table "), number)}), texts=False))
    listed = F.array_join(F.transform("tables", lambda x: F.concat_ws(" ", x["table_id"], x["caption"], x["page"].cast("string"))), ";")
    return out.select("doc_id", F.col("order").cast("long").alias("section_no"), "id", "title", "file", "page_start", "page_end", F.col("word_count").cast("long").alias("word_count"), listed.alias("tables"), F.col("table_count").cast("long").alias("table_count"))


OUTLINE = f"""{LINES}, o AS (SELECT doc_id, line_no, CAST(line_no // 20 + 1 AS INT) AS page, CASE WHEN line_no % 7 = 3 THEN 'Annex ' || chr(CAST(65 + line_no % 5 AS INT)) || ' more' WHEN line_no % 11 = 5 THEN 'Scope' ELSE '> ' || text END AS text FROM l),
h AS (SELECT *, line_no % 7 = 3 OR line_no % 11 = 5 AS head FROM o), q AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS seq FROM h),
a AS (SELECT doc_id, seq, min_by(page, line_no) AS start_page, count(*) - bool_or(head)::INT AS line_count, min_by(text, line_no) AS first FROM q GROUP BY doc_id, seq)"""


@query(
    f"WITH {OUTLINE} SELECT doc_id, CASE WHEN seq = 0 THEN 'meta' WHEN first = 'Scope' THEN 'named' ELSE 'annex' END AS kind, CASE WHEN seq = 0 THEN 'Front matter' ELSE first END AS title, start_page, CAST(line_count AS BIGINT) AS line_count FROM a WHERE line_count > 0"
)
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).selectExpr("doc_id", "line_no", "cast(line_no div 20 + 1 as int) as page", "case when line_no % 7 = 3 then concat('Annex ', chr(65 + line_no % 5), ' more') when line_no % 11 = 5 then 'Scope' else concat('> ', text) end as text")
    return sections.outline(rows).select("doc_id", "kind", "title", "start_page", "line_count")


@query(
    f"WITH {CLASSIFIED}, q AS (SELECT *, sum((type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS seq FROM classified) "
    "SELECT doc_id, CASE WHEN seq = 0 THEN 'topic_default' ELSE 'b' || min(line_no) END AS topic_id, CASE WHEN seq = 0 THEN 1 ELSE min_by(page, line_no) END AS page, CAST(count(*) - CASE WHEN seq = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_blocks FROM q GROUP BY doc_id, seq"
)
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.classify(layout(spark, sf_dir)).select("doc_id", F.col("line_no").alias("block_no"), F.concat(F.lit("b"), F.col("line_no").cast("string")).alias("block_id"), "page", "text", "type")
    return sections.topics(rows).select("doc_id", "topic_id", "page", F.size("block_ids").cast("long").alias("n_blocks"))


# --- contents

TOC_TEXT = f"""{TOC}, f AS (SELECT *, lower(trim(text)) IN ('contents', 'table of contents') AS start, trim(text) <> '' AND (regexp_matches(text, '\\.{{5,}}') OR regexp_matches(lower(text), '\\s([0-9]{{1,4}}|[ivxlcdm]{{1,8}})\\s*$')) AS entry,
  len(regexp_extract_all(text, '\\S+')) >= 10 AND regexp_matches(text, '[a-zA-Z]') AS para FROM toc),
x AS (SELECT *, first_value(CASE WHEN trim(text) <> '' THEN para END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_para,
  min(CASE WHEN start AND line_no < 400 THEN line_no END) OVER (PARTITION BY doc_id) AS s0, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM f),
y AS (SELECT *, sum((entry AND line_no > s0 AND line_no <= s0 + 119)::INT) OVER (PARTITION BY doc_id) >= 5 AS gate,
  max((NOT start AND NOT entry AND NOT regexp_matches(trim(text), '^[0-9]+(\\.[0-9]+)+$') AND (para OR coalesce(next_para, FALSE)))::INT) OVER (PARTITION BY doc_id, part ORDER BY line_no) AS ended FROM x)"""


@query(f"WITH {TOC_TEXT} SELECT doc_id, line_no, text FROM y WHERE NOT coalesce(s0 IS NOT NULL AND gate, FALSE) OR (NOT start AND (part = 0 OR ended = 1))")
def toc_drop_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.drop_from_lines(toc_lines(spark, sf_dir))


TOC_BLOCKS = f"""{TOC}, f AS (SELECT doc_id, line_no, CAST(line_no // 5 + 1 AS INT) AS page, text, line_no = 1 AS start FROM toc),
x AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM f),
y AS (SELECT *, first_value(page) OVER (PARTITION BY doc_id, part ORDER BY line_no) AS p0 FROM x),
z AS (SELECT *, max((NOT start AND (page > p0 + 2 OR (NOT regexp_matches(trim(text), '^[0-9]+(\\.[0-9]+)+$') AND NOT regexp_matches(lower(trim(text)), '\\s([0-9]{{1,3}}|[ivxlcdm]{{1,6}})$') AND len(regexp_extract_all(text, '\\S+')) >= 12)))::INT) OVER (PARTITION BY doc_id, part ORDER BY line_no) AS ended FROM y)"""


@query(f"WITH {TOC_BLOCKS} SELECT doc_id, line_no AS block_no, text FROM z WHERE NOT start AND (part = 0 OR ended = 1)")
def toc_drop_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toc_lines(spark, sf_dir).selectExpr("doc_id", "line_no as block_no", "cast(line_no div 5 + 1 as int) as page", "case when line_no = 1 then 'heading' else 'paragraph' end as type", "text")
    return toc.drop_from_blocks(rows).select("doc_id", "block_no", "text")


# --- chunks

CHUNKS = f"""WITH RECURSIVE {LINES}, p AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM (SELECT doc_id, line_no, {ws("regexp_replace(text, '<[^>]+>', ' ', 'g')")} AS text FROM l
  WHERE NOT regexp_matches(lower(text), 'for bis use only|copyright protected document|all rights reserved|© iso|published in switzerland')) WHERE text <> ''),
c AS (SELECT doc_id, n, 1 AS chunk_no, length(text) + 2 AS size FROM p WHERE n = 1
  UNION ALL SELECT p.doc_id, p.n, CASE WHEN c.size + length(p.text) + 2 > 1800 THEN c.chunk_no + 1 ELSE c.chunk_no END, CASE WHEN c.size + length(p.text) + 2 > 1800 THEN length(p.text) + 2 ELSE c.size + length(p.text) + 2 END FROM c JOIN p ON p.doc_id = c.doc_id AND p.n = c.n + 1),
chunks AS (SELECT c.doc_id, chunk_no, string_agg(text, chr(10) || chr(10) ORDER BY c.n) AS text FROM c JOIN p USING (doc_id, n) GROUP BY c.doc_id, chunk_no)"""


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(F.split("text", "\n", -1), lambda x: ~f.boilerplate(x))
    return chunks.exploded(table(spark, sf_dir, "documents"), chunks.line_chunks(kept), "doc_id")


@query(f"{CHUNKS} SELECT doc_id, chunk_no, text, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS words FROM chunks")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _chunked(spark, sf_dir)
    return out.select("doc_id", "chunk_no", "text", F.col("chars").cast("long").alias("chars"), F.col("words").cast("long").alias("words"))


@query(f"{CHUNKS} SELECT doc_id, printf('chunk_%04d', chunk_no) AS chunk, CAST(chunk_no AS BIGINT) AS section_piece_index, count(*) OVER (PARTITION BY doc_id) AS section_piece_total, length(text) AS chars FROM chunks")
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~f.boilerplate(x)), "\n\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("section_no"), kept.alias("text"))
    out = chunks.exploded(docs, chunks.text_chunks(F.col("text")), "doc_id", "section_no")
    return out.select("doc_id", F.format_string("chunk_%04d", "chunk_no").alias("chunk"), F.col("chunk_no").cast("long").alias("section_piece_index"), F.count("*").over(Window.partitionBy("doc_id")).alias("section_piece_total"), F.col("chars").cast("long").alias("chars"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id as doc_id", "turn as block_no", "case when role = 'user' then 'heading' else 'paragraph' end as type", "text")


TURNS = f"""t AS (SELECT *, {ws("regexp_replace(text, '<[^>]+>', ' ', 'g')")} AS t FROM conversations),
p AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE WHEN role = 'user' THEN chr(10) || chr(10) ELSE '' END || t || chr(10) || chr(10) AS piece FROM t WHERE t <> '')"""
SPOKEN_TURNS = f"""t AS (SELECT *, replace(replace(replace({ws('text')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM conversations),
p AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
  CASE WHEN role = 'user' THEN '<break time="600ms"/><emphasis level="moderate">' || t || '</emphasis><break time="400ms"/>' ELSE t || '<break time="350ms"/>' END AS piece FROM t)"""


def _greedy(longest: int) -> str:
    """Chunks by a walk over the pieces ``p``."""
    return f"""c AS (SELECT doc_id, n, 1 AS chunk_no, length(piece) AS size FROM p WHERE n = 1
  UNION ALL SELECT p.doc_id, p.n, CASE WHEN c.size + length(piece) > {longest} THEN c.chunk_no + 1 ELSE c.chunk_no END, CASE WHEN c.size + length(piece) > {longest} THEN length(piece) ELSE c.size + length(piece) END FROM c JOIN p ON p.doc_id = c.doc_id AND p.n = c.n + 1)"""


@query(
    f"WITH RECURSIVE {TURNS}, {_greedy(600)}, g AS (SELECT doc_id, chunk_no, trim(string_agg(piece, '' ORDER BY n), chr(10)) AS text FROM c JOIN p USING (doc_id, n) GROUP BY ALL) "
    "SELECT doc_id, chunk_no, text, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS words FROM g"
)
def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.block_chunks(_turns(spark, sf_dir), longest=600)
    return out.select("doc_id", "chunk_no", "text", F.col("chars").cast("long").alias("chars"), F.col("words").cast("long").alias("words"))


@query(
    f"WITH RECURSIVE {SPOKEN_TURNS}, {_greedy(4000)} "
    "SELECT doc_id, chunk_no, '<speak>' || chr(10) || string_agg(piece, chr(10) ORDER BY n) || chr(10) || '</speak>' AS ssml, count(*) AS n_blocks FROM c JOIN p USING (doc_id, n) GROUP BY ALL"
)
def ssml_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.ssml_chunks(_turns(spark, sf_dir)).withColumn("n_blocks", F.col("n_blocks").cast("long"))


@query("SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS words, len(string_split(text, chr(10))) AS n_lines FROM documents")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), t.word_count(F.col("text")).cast("long").alias("words"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))


# --- tables


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey % 20 as doc_id", "cast(p_partkey % 7 + 1 as int) as page",
        "case p_partkey % 4 when 0 then concat('Table ', p_partkey, ' — ', p_name) when 1 then concat('table ', p_partkey) when 2 then concat('Table ', p_partkey, ' (continued)') else concat('In Table ', p_partkey) end as text",
        "array(72D, cast(p_size * 10 as double), 300D, cast(p_size * 10 + 12 as double)) as bbox", "595D as page_w", "842D as page_h",
    )


CAPTIONS = """caps AS (SELECT p_partkey % 20 AS doc_id, CAST(p_partkey % 7 + 1 AS INT) AS page, CAST(p_partkey AS INT) AS num, p_size * 10 AS y0, p_size * 10 + 12 AS y1 FROM part WHERE p_partkey % 4 <> 3)"""


@query(f"WITH {CAPTIONS} SELECT doc_id, page, num FROM caps")
def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.captions(_captions(spark, sf_dir)).select("doc_id", "page", "num")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey % 20 as doc_id", "explode(array(1, 2, 3, 4, 5, 6, 7)) as page", "array(cast(s_suppkey as double), cast(s_suppkey * 31 % 700 as double), 500D, cast(s_suppkey * 31 % 700 + 40 as double)) as bbox")


REGIONS = "regions AS (SELECT s_suppkey % 20 AS doc_id, unnest([1, 2, 3, 4, 5, 6, 7]) AS page, s_suppkey AS x0, s_suppkey * 31 % 700 AS y0, 500 AS x1, s_suppkey * 31 % 700 + 40 AS y1 FROM supplier)"


@query(
    f"WITH {CAPTIONS}, {REGIONS}, m AS (SELECT c.*, r.x0 AS rx, r.y0 AS ry, row_number() OVER (PARTITION BY c.doc_id, c.page, c.num, c.y0 ORDER BY greatest(0, r.y0 - c.y1), r.y0, r.x0) AS rn FROM caps c LEFT JOIN regions r ON c.doc_id = r.doc_id AND c.page = r.page AND r.y0 >= c.y0 - 6) "
    "SELECT doc_id, page, num, 'T' || num || '_P' || page AS hit_id, CAST(coalesce(rx, 0) AS INT) AS x0, CAST(coalesce(ry, y1) AS INT) AS y0 FROM m WHERE rn = 1"
)
def table_nearest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.placed(tables.captions(_captions(spark, sf_dir)), _regions(spark, sf_dir))
    return out.select("doc_id", "page", "num", "hit_id", F.col("bbox")[0].cast("int").alias("x0"), F.col("bbox")[1].cast("int").alias("y0"))


@query(
    f"WITH {LAYOUT}, {REGIONS} SELECT doc_id, line_no FROM layout WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.doc_id = layout.doc_id AND r.page = layout.page AND x + 200 >= r.x0 - 3 AND r.x1 >= x - 3 AND y + 10 >= r.y0 - 3 AND r.y1 >= y - 3)"
)
def table_region_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = layout(spark, sf_dir).withColumn("bbox", F.array("x", "y", F.col("x") + 200, F.col("y") + 10))
    return lines.outside_regions(spans, _regions(spark, sf_dir)).select("doc_id", "line_no")


@query()
def ruled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 50 as doc_id", "cast(l_linenumber as int) as page", "l_orderkey as drawing_no",
        "array(cast(72 + l_partkey % 400 as double), cast(100 + l_suppkey % 600 as double), cast(92 + l_partkey % 400 as double), cast(112 + l_suppkey % 600 as double)) as bbox", "595D as page_w", "842D as page_h",
    )
    return tables.ruled_regions(rows)


def _token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as doc_id", "o_orderkey as block_no", "cast(o_orderkey % 9 + 1 as int) as page", "'paragraph' as type",
        "concat('See [[TABLE|t', o_orderkey % 5, '|Table ', o_orderkey % 3, ' of ', o_orderkey, ']] here, [[FORMULA|F', o_orderkey % 4, '|x]] and [FORMULA:F9].') as text",
    )


@query(
    "WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS k, 'T' || (o_orderkey % 3) AS table_id, 't' || (o_orderkey % 5) AS hit, o_orderkey % 9 + 1 AS page, 'Table ' || (o_orderkey % 3) || ' of ' || o_orderkey AS caption FROM orders), "
    "o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, table_id, page, hit ORDER BY k) = 1), "
    "g AS (SELECT doc_id, table_id, string_agg(page || ' ' || hit || ' ' || caption, ';' ORDER BY page, k) AS occurrences, min(page) AS first_page FROM o GROUP BY ALL), "
    "c AS (SELECT doc_id, table_id, caption FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, table_id ORDER BY length(caption) DESC, k) = 1) "
    "SELECT doc_id, table_id, caption, occurrences, row_number() OVER (PARTITION BY doc_id ORDER BY first_page, table_id) AS position FROM g JOIN c USING (doc_id, table_id)"
)
def table_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.index(_token_blocks(spark, sf_dir))
    seen = F.array_join(F.transform("occurrences", lambda x: F.concat_ws(" ", x["page"].cast("string"), x["hit_id"], x["caption"])), ";")
    return out.select("doc_id", "table_id", "caption", seen.alias("occurrences"), F.col("position").cast("long").alias("position"))


@query("SELECT p_partkey, 'T' || CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_partkey % 10000 ELSE p_size + 1 END AS table_id FROM part")
def canonical_table_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    raw = F.expr("case p_partkey % 3 when 0 then 'x' when 1 then concat('t0', p_partkey % 10000) else concat('the table ', p_size + 1) end")
    raw = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("T"), (F.col("p_partkey") % 10000).cast("string"))).otherwise(raw)
    caption = F.expr("case p_partkey % 3 when 0 then concat('TABLE ', p_size, ' - sizes') else '' end")
    return rows.select("p_partkey", k.canonical_table_id(raw, caption).alias("table_id"))


@query("SELECT o_custkey AS doc_id, 't' || (o_orderkey % 5) AS table_id, 'Table ' || (min(o_orderkey) % 3) || ' of ' || min(o_orderkey) AS caption FROM orders WHERE o_orderkey % 5 <> 2 OR o_custkey % 3 = 0 GROUP BY o_custkey, o_orderkey % 5")
def missing_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.missing_explanations(_token_blocks(spark, sf_dir), _told(spark, sf_dir))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents not divisible by 3 explain t2, and all of them t3, twice, with blanks."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as doc_id", "explode(array(named_struct('id', if(c_custkey % 3 = 0, 't9', 't2'), 'text', concat('Known ', c_custkey, '.')), named_struct('id', 't3', 'text', ' '), named_struct('id', 't3', 'text', '  '))) as x").select("doc_id", "x.*")


@query(
    "SELECT o_custkey AS doc_id, o_orderkey AS block_no, 'See Table ' || (o_orderkey % 3) || ' of ' || o_orderkey || '. ' || CASE WHEN o_orderkey % 5 = 2 AND o_custkey % 3 <> 0 THEN 'Known ' || o_custkey || '.' ELSE 'This is a table. Please provide a short explanation for table id t' || (o_orderkey % 5) || '.' END || ' here, [[FORMULA|F' || (o_orderkey % 4) || '|x]] and [FORMULA:F9].' AS text FROM orders"
)
def spoken_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents share table ids and explain them differently."""
    from lectern import plans

    return plans.spoken_blocks(_token_blocks(spark, sf_dir), _told(spark, sf_dir)).select("doc_id", "block_no", "text")


@query("SELECT s_suppkey % 20 AS doc_id, page, count(*) AS n_tables, string_agg('T' || s_suppkey, ',' ORDER BY s_suppkey * 31 % 700, s_suppkey) AS table_ids FROM (SELECT s_suppkey, unnest([1, 2, 3, 4, 5, 6, 7]) AS page FROM supplier) GROUP BY 1, 2")
def tables_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _regions(spark, sf_dir).withColumn("table_id", F.concat(F.lit("T"), F.col("bbox")[0].cast("int").cast("string")))
    return tables.per_page(found).select("doc_id", "page", "n_tables", F.array_join("table_ids", ",").alias("table_ids"))


@query("SELECT o_custkey AS doc_id, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'runs/a/s' || o_orderkey || '.txt' WHEN 1 THEN 'orig/s' || o_orderkey || '.txt' END AS path FROM orders")
def section_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey as doc_id", "o_orderkey", "concat('runs/a/s', o_orderkey, '.txt') as file")
    there = rows.where("o_orderkey % 3 < 2").selectExpr("doc_id", "if(o_orderkey % 3 = 0, file, concat('orig/s', o_orderkey, '.txt')) as path")
    return overlay.section_files(rows, there).select("doc_id", "o_orderkey", "path")


@query(
    "SELECT o_orderkey, 'See Table ' || (o_orderkey % 3) || ' of ' || o_orderkey || '. ' || CASE o_orderkey % 5 WHEN 2 THEN 'Known.' ELSE 'This is a table. Please provide a short explanation for table id t' || (o_orderkey % 5) || '.' END || ' here, [[FORMULA|F' || (o_orderkey % 4) || '|x]] and [FORMULA:F9].' AS text FROM orders"
)
def token_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.create_map(F.lit("t2"), F.lit("Known."))
    return _token_blocks(spark, sf_dir).select(F.col("block_no").alias("o_orderkey"), k.replace_tables(F.col("text"), told).alias("text"))


@query(
    "SELECT o_orderkey, 'See [[TABLE|t' || (o_orderkey % 5) || '|Table ' || (o_orderkey % 3) || ' of ' || o_orderkey || ']] here,  Formula F' || (o_orderkey % 4) || CASE o_orderkey % 4 WHEN 1 THEN ': x over y ' ELSE '. ' END || ' and  Formula F9. .' AS text FROM orders"
)
def formula_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.create_map(F.lit("F1"), F.lit("x over y"))
    return _token_blocks(spark, sf_dir).select(F.col("block_no").alias("o_orderkey"), k.narrate_formulas(F.col("text"), told).alias("text"))


# --- formulas


@query(
    f"WITH {LINES}, n AS (SELECT doc_id, line_no, {ws("translate(text, '–—' || chr(173), '--')")} AS t FROM l) SELECT doc_id, line_no FROM n WHERE t <> '' AND length(t) <= 900 AND (regexp_matches(t, '^\\(\\s*[0-9]{{1,4}}\\s*\\)$') OR regexp_matches(t, '[=±×*/^_∑∏√∫≈≠≤≥→←↔∞αβγΔμΩπθλ∈∉∩∪∂∇·•]') "
    "OR regexp_matches(t, '(?i)\\b(sum|prod|sqrt|lim|log|ln|sin|cos|tan|exp|min|max)\\b') OR (length(regexp_replace(t, '[^=+\\-*/^_(){}\\[\\]]', '', 'g')) >= 2 AND length(regexp_replace(t, '[^0-9]', '', 'g')) >= 2))"
)
def formula_text_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).where(f.formula_text(F.col("text"))).select("doc_id", "line_no")


def _formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout lines of which some are equation numbers at the right margin and some displayed equations."""
    rows = layout(spark, sf_dir)
    number, shown = (F.col("doc_id") % 3 == 0) & (F.col("line_no") % 10 == 4), (F.col("doc_id") % 3 == 1) & (F.col("line_no") % 10 == 4)
    edge = (F.col("doc_id") % 3 == 2) & (F.col("line_no") % 10 == 4)  # too far left to count as displayed
    text = F.when(number, F.concat(F.lit("("), F.col("line_no").cast("string"), F.lit(")"))).when(shown, F.lit("y = a x")).when(edge, F.lit("z = b x")).otherwise(F.lit("plain words"))
    x0 = F.when(number, 500.0).when(edge, 10.0).otherwise(F.col("x"))
    return rows.select("doc_id", "page", "line_no", text.alias("text"), F.array(x0, F.col("y"), x0 + 120, F.col("y") + 10).alias("bbox"), "page_w")


FORMULAS = f"""{LAYOUT}, fl AS (SELECT doc_id, page, line_no, doc_id % 3 = 0 AND line_no % 10 = 4 AS number, doc_id % 3 = 1 AND line_no % 10 = 4 AS shown, CASE WHEN doc_id % 3 = 0 AND line_no % 10 = 4 THEN 500 WHEN doc_id % 3 = 2 AND line_no % 10 = 4 THEN 10 ELSE x END AS x0, y AS y0 FROM layout),
eq AS (SELECT a.doc_id, a.page, a.line_no, min(o.x0) AS x0, min(o.y0) AS y0, any_value(a.x0) + 120 AS x1, max(o.y0) + 10 AS y1 FROM fl a JOIN fl o ON a.doc_id = o.doc_id AND a.page = o.page AND (abs(o.y0 - a.y0) <= 90 OR (abs(o.y0 - a.y0) <= 160 AND o.x0 >= 595 * 0.05 AND o.x0 + 120 <= 595 * 0.95)) WHERE a.number GROUP BY 1, 2, 3),
eqd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, floor(x0 / 5), floor(y0 / 5), floor(x1 / 5), floor(y1 / 5) ORDER BY line_no) AS rn FROM eq),
ly AS (SELECT a.doc_id, a.page, a.line_no, min(o.x0) AS x0, min(o.y0) AS y0, max(o.x0) + 120 AS x1, max(o.y0) + 10 AS y1 FROM fl a JOIN fl o ON a.doc_id = o.doc_id AND a.page = o.page AND (a.line_no = o.line_no OR (abs(o.y0 - a.y0) <= 120 AND (least(o.x0, a.x0) + 120 - greatest(o.x0, a.x0)) / 120.0 >= 0.35)) WHERE a.shown GROUP BY 1, 2, 3),
lyd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, floor(x0 / 8), floor(y0 / 8), floor(x1 / 8), floor(y1 / 8) ORDER BY line_no) AS rn FROM ly)"""
BOX = "CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1"


def _boxes(rows: DataFrame, *also: str) -> DataFrame:
    return rows.select("doc_id", "page", *also, *[F.col("bbox")[n].cast("int").alias(c) for n, c in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"WITH {FORMULAS} SELECT doc_id, page, {BOX} FROM eqd WHERE rn = 1")
def eqno_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(formulas.numbered_equations(_formula_lines(spark, sf_dir)))


@query(f"WITH {FORMULAS} SELECT doc_id, page, {BOX} FROM lyd WHERE rn = 1")
def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(formulas.displayed_equations(_formula_lines(spark, sf_dir).where("text not rlike '^\\\\('")))


@query(f"WITH {FORMULAS} SELECT doc_id, page, 0 AS tier, {BOX} FROM eqd WHERE rn = 1 UNION ALL SELECT doc_id, page, 1, {BOX} FROM lyd WHERE rn = 1 UNION ALL SELECT doc_id, page, 2, 10, CAST(y0 AS INT), 130, CAST(y0 + 10 AS INT) FROM fl WHERE doc_id % 3 = 2 AND line_no % 10 = 4")
def formula_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(formulas.page_regions(_formula_lines(spark, sf_dir)), "tier")


@query(
    f"WITH {HEADINGS}, f AS (SELECT doc_id, page, 'F' || line_no AS id FROM layout WHERE line_no % 13 = 6), "
    "n AS (SELECT s.doc_id, s.seq, string_agg('- ' || id || ' (page ' || f.page || '): qqq', chr(10) ORDER BY f.page, id) AS told FROM sections s JOIN f ON s.doc_id = f.doc_id AND f.page BETWEEN s.page_start AND s.page_end GROUP BY 1, 2) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS section_no, text || coalesce(chr(10) || chr(10) || 'Formulas in this section:' || chr(10) || told, '') AS text FROM sections LEFT JOIN n USING (doc_id, seq)"
)
def section_formula_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = layout(spark, sf_dir).where("line_no % 13 = 6").selectExpr("doc_id", "page", "concat('F', line_no) as formula_id", "'qqq' as text")
    out = formulas.append_to_sections(sections.build(heading_blocks(spark, sf_dir)), told)
    return out.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "text")


@query(
    f"WITH {LINES}, t AS (SELECT doc_id, line_no, trim(text, ' ' || chr(9)) AS text FROM l), w AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words FROM t WHERE text <> '') "
    "SELECT doc_id, 'p' || (CAST(floor(line_no / 20) AS INT) + 1) || '_b' || line_no || '_' || substr(sha256(doc_id || '|' || (CAST(floor(line_no / 20) AS INT) + 1) || '|' || line_no || '|' || text), 1, 6) AS block_id, "
    "CASE WHEN length(text) BETWEEN 3 AND 70 AND NOT ends_with(text, '.') AND ((upper(text) = text AND lower(text) <> text) OR (len(words) BETWEEN 1 AND 10 AND len(list_filter(words, lambda x: regexp_matches(x, '^\\p{Lu}'))) / len(words) >= 0.6)) THEN 'heading' ELSE 'paragraph' END AS type FROM w"
)
def block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.scanned_blocks(layout(spark, sf_dir).withColumn("block_no", F.col("line_no"))).select("doc_id", "block_id", "type")


@query(
    f"WITH {FORMULAS}, tiers AS (SELECT doc_id, page, line_no, 0 AS tier FROM eqd WHERE rn = 1 UNION ALL SELECT doc_id, page, line_no, 1 FROM lyd WHERE rn = 1 UNION ALL SELECT doc_id, page, line_no, 2 FROM fl WHERE doc_id % 3 = 2 AND line_no % 10 = 4), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS seq FROM tiers), "
    "made AS (SELECT doc_id, 'F' || CASE WHEN tier = 0 THEN line_no ELSE seq END || '_p' || page || '_' || seq AS formula_id, page, "
    "CASE WHEN seq % 4 = 0 THEN 'first' WHEN seq % 4 = 1 THEN 'second' ELSE 'text' END AS provider, "
    "CASE WHEN seq % 4 = 0 THEN 'p=q' WHEN seq % 4 = 1 THEN 'r=s' WHEN tier = 0 THEN '(' || line_no || ')' WHEN tier = 1 THEN '' ELSE 'z = b x' END AS latex, CASE WHEN seq % 4 = 3 THEN 'no image' END AS error FROM s), "
    "spoken AS (SELECT *, CASE latex WHEN 'p=q' THEN 'p equals q' WHEN 'r=s' THEN 'r equals s' WHEN 'z = b x' THEN 'z equals b x' ELSE latex END AS said FROM made) "
    "SELECT 'formula' AS result, doc_id, CAST(0 AS BIGINT) AS block_no, formula_id, page, provider, latex AS text, error FROM made "
    "UNION ALL SELECT 'block', doc_id, 1 + row_number() OVER (PARTITION BY doc_id ORDER BY page, formula_id), NULL, page, NULL, '[[FORMULA|' || formula_id || '|]]', NULL FROM made WHERE error IS NULL "
    "UNION ALL SELECT 'block', doc_id, 1, NULL, 1, NULL, 'words', NULL FROM documents "
    "UNION ALL SELECT 'narration', doc_id, 0, formula_id, page, NULL, CASE WHEN formula_id LIKE 'F4%' THEN 'of doc ' || doc_id ELSE said END, NULL FROM spoken WHERE error IS NULL AND (said <> '' OR formula_id LIKE 'F4%')"
)
def formula_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to formulas, blocks with their tokens, and narrations: two recognisers, the second asked where the first is bad, some images missing, some formulas told by the user."""
    from lectern import plans

    rows = _formula_lines(spark, sf_dir)
    found = table(spark, sf_dir, "documents").selectExpr("doc_id", "1L as block_no", "'paragraph' as type", "1 as page", "cast(null as array<double>) as bbox", "'words' as text")
    seq = "cast(regexp_extract(formula_id, '_([0-9]+)$', 1) as int)"
    ids = plans.narrated_formulas(found, rows)[0]
    seen = ids.selectExpr("doc_id", "formula_id", f"case {seq} % 4 when 0 then 'p=q' when 1 then '??' end as first", f"case when {seq} % 4 = 1 then 'r=s' end as second", f"case when {seq} % 4 = 3 then 'no image' end as error")
    told = ids.where("formula_id like 'F4%'").selectExpr("doc_id", "formula_id as id", "concat(' of doc ', doc_id) as text")
    made, blocks, said = plans.narrated_formulas(found, rows, seen, told, providers=("first", "second"))
    row = lambda df, kind, **c: df.select(F.lit(kind).alias("result"), "doc_id", *[F.expr(c.get(k, f"cast(null as {t})")).alias(k) for k, t in (("block_no", "long"), ("formula_id", "string"), ("page", "int"), ("provider", "string"), ("text", "string"), ("error", "string"))])
    out = row(made, "formula", block_no="0L", formula_id="formula_id", page="page", provider="provider", text="latex", error="error")
    out = out.unionByName(row(blocks, "block", block_no="cast(block_no as long)", page="page", text="text"))
    return out.unionByName(row(said, "narration", block_no="0L", formula_id="formula_id", page="page", text="text"))


@query()
def wide_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of lines to blocks in the wider form."""
    from lectern import plans

    spans = layout(spark, sf_dir).select("doc_id", "page", F.lit(0).alias("block_no"), "line_no", F.lit(0).alias("span_no"), "text", F.col("avg_size").alias("size"), (F.col("bold_ratio") > 0).alias("bold"), F.lit(False).alias("italic"), F.array("x", "y", F.col("x") + 200, F.col("y") + 10).alias("bbox"), "page_w", "page_h")
    return plans.spans_to_normalized_blocks(spans).select("doc_id", "block_no", "type", "text")


# --- versions and selections


@query("SELECT d.doc_id, CASE WHEN quality = 1 THEN 'user ' || d.doc_id ELSE d.text END AS text FROM documents d LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) <> 0 AND trim(d.text) <> ''")
def section_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("user "), F.col("doc_id").cast("string"))).otherwise("").alias("text"))
    return overlay.overlay(table(spark, sf_dir, "documents").select("doc_id", "text"), user, keys=["doc_id"])


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) AND trim(text) <> ''")
def section_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "labels").where("toxic = 0")
    return overlay.selected(table(spark, sf_dir, "documents").select("doc_id", "text"), chosen, ["doc_id"])


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(f.title_search(F.col("text"), "THE")).select("doc_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'latex ' || o_custkey END AS latex, CASE WHEN o_orderkey % 3 = 0 THEN 'cache' END AS provider FROM orders")
def recognition_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("sha256", F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256))
    cache = rows.where("o_orderkey % 3 = 0").select("sha256", F.concat(F.lit("latex "), F.col("o_custkey").cast("string")).alias("latex"), F.lit(None).cast("string").alias("provider"))
    return overlay.cached(rows.select("o_orderkey", "sha256"), cache).select("o_orderkey", "latex", "provider")


def _first_half(contents: list[bytes]) -> list[str | None]:
    return ["??" if len(c) % 3 == 0 else c[: len(c) // 2].decode(errors="replace") for c in contents]


def _failing(contents: list[bytes]) -> list[str | None]:
    if any(len(c) % 2 for c in contents):
        raise ValueError("odd")
    return [f"x = {len(c)}" for c in contents]


@query(
    "SELECT o_orderkey, CASE WHEN n % 3 <> 0 THEN substr(c, 1, n // 2) WHEN n % 2 = 0 THEN 'x = ' || n END AS latex, CASE WHEN n % 3 <> 0 THEN 'half' WHEN n % 2 = 0 THEN 'length' END AS provider, "
    "CASE WHEN n % 3 = 0 AND n % 2 = 1 THEN 'length: ValueError: odd' END AS error FROM (SELECT o_orderkey, 'price ' || o_orderpriority || repeat('c', CAST(o_custkey % 12 AS INT)) AS c, 6 + length(o_orderpriority) + CAST(o_custkey % 12 AS INT) AS n FROM orders)"
)
def recognition_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recognisers over contents that many rows share; the second is asked for what the first reads badly, and fails on some."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("cast(concat('price ', o_orderpriority, repeat('c', cast(o_custkey % 12 as int))) as binary)").alias("image"))
    found = recognise.readings(rows, [("half", lambda: _first_half), ("length", lambda: _failing)])
    return recognise.with_readings(rows, found).select("o_orderkey", "latex", "provider", "error")


@query("SELECT conv_id AS doc_id, count(*) AS n_parts, sha256(string_agg(text, '' ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id")
def audio_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("part_no"), F.lit("22050 Hz").alias("params"), F.col("text").cast("binary").alias("frames"))
    return overlay.merged_audio(parts).select("doc_id", "n_parts", F.sha2("frames", 256).alias("sha256"))


@query()
def normalized_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern import plans

    return plans.normalize_sections(sections.build(heading_blocks(spark, sf_dir))).select("doc_id", "section_no", "title", "text")


@query()
def wide_normalized_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern import plans

    return plans.normalize_blocks(heading_blocks(spark, sf_dir)).select("doc_id", "block_no", "type", "text")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern import streaming

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streaming.event_windows(events)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
