"""DataFrame operators on small tables."""

import pytest
from pyspark.sql import functions as F

from lectern import sources, streaming
from lectern.operators import blocks, chunks, formulas, lines, overlay, sections, tables, toc
from lectern.plans import documents_to_sections, normalize_sections, spoken_blocks
from lectern.queries import queries


def spans(spark, rows):
    """(page, line, text, x, y, size) as spans of one document."""
    data = [(1, p, 0, n, k, t, float(s), "Bold" if s > 13 else "Plain", [float(x), float(y), float(x + 100), float(y + 10)], 600.0, 800.0) for k, (p, n, t, x, y, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, page int, block_no int, line_no int, span_no int, text string, size double, font string, bbox array<double>, page_w double, page_h double")
    return df.withColumn("bold", F.col("font") == "Bold").withColumn("italic", F.lit(False))


def test_lines_and_furniture(spark):
    rows = [(1, 0, "Supplied by X", 72, 100, 11), (1, 1, "top", 72, 1, 11), (1, 2, "hel", 72, 120, 11), (1, 2, "lo ", 90, 120, 11), (1, 3, "12", 500, 700, 11), (1, 4, "BS", 500, 300, 11), (1, 5, "drop me", 72, 200, 11)]
    kept = lines.clean_spans(spans(spark, rows), rules={"exact": ["drop me"], "regex": ["("]})
    assert [r.text for r in lines.assemble(kept).collect()] == ["hello"]


def test_remove_rules_keep_valid_patterns(spark):
    df = spark.createDataFrame([("a1",), ("b",), ("",)], "text string")
    assert [r.text for r in lines.remove_by_rules(df, {"regex": ["(", r"^a\d"]}).collect()] == ["b", ""]


def test_regions_suppress_spans(spark):
    df = spans(spark, [(1, 0, "in", 72, 100, 11), (1, 1, "out", 72, 300, 11)])
    region = spark.createDataFrame([(1, 1, [0.0, 90.0, 600.0, 120.0])], "doc_id long, page int, bbox array<double>")
    assert [r.text for r in lines.outside_regions(df, region).collect()] == ["out"]


def test_repeated(spark):
    df = spark.createDataFrame([(1, p, "a line that is long enough") for p in (1, 2)] + [(1, 1, "short"), (1, 2, "short"), (1, 3, "x")], "doc_id long, page int, text string")
    assert [r.text for r in lines.repeated(df).collect()] == ["a line that is long enough"]
    assert {r.text for r in lines.repeated(df, profile="step3").collect()} == {"a line that is long enough", "short"}


def laid(spark, rows):
    return spark.createDataFrame([(1, n, p, float(x), float(y), float(s), 0.0, t) for n, (p, x, y, s, t) in enumerate(rows)], "doc_id long, line_no long, page int, x double, y double, avg_size double, bold_ratio double, text string")


def test_blocks(spark):
    rows = [(1, 72, 10, 18, "1 Scope"), (1, 72, 30, 11, "one"), (1, 72, 42, 11, "Two is another one"), (1, 72, 90, 11, "three"), (1, 150, 92, 11, "four"), (2, 72, 10, 11, "five")]
    found = blocks.merge(laid(spark, rows)).orderBy("block_no").collect()
    assert [(r.type, r.text) for r in found] == [("heading", "1 Scope"), ("paragraph", "one\nTwo is another one"), ("paragraph", "three"), ("paragraph", "four"), ("paragraph", "five")]
    assert blocks.body_size(laid(spark, [(1, 0, 0, 20, "x")])).first().body_size == 11.0


def blocked(spark, rows):
    return spark.createDataFrame([(1, n, *r) for n, r in enumerate(rows)], "doc_id long, block_no int, type string, page int, text string")


def test_sections(spark):
    rows = [("paragraph", 2, "front"), ("table", 3, "[TABLE:T1] Table 1"), ("heading", 3, "1 Scope of it"), ("paragraph", 4, "body"), ("heading", 5, "no heading"), ("heading", 6, "Annex B x")]
    built = sections.build(blocked(spark, rows)).orderBy("section_no")
    found = built.collect()
    assert [(r.id, r.title, r.page_start, r.page_end) for r in found] == [("00_front_matter", "Front matter", 1, 3), ("1_scope_of_it", "1 Scope of it", 3, 5), ("annex_b", "Annex B", 6, 6)]
    assert found[0].text == "front\n\n[[TABLE|T1|Table 1]]" and found[0].tables[0].table_id == "T1"
    assert [(r.file, r.word_count, r.table_count) for r in sections.manifest(built).orderBy("order").collect()][1] == ("01_1_scope_of_it.txt", 7, 0)


def test_manifest_counts_words_without_joining_texts(spark):
    odd = [("heading", 1, " 1 Scope\u00a0of  it "), ("paragraph", 1, "\u3000"), ("paragraph", 2, None), ("table", 2, "x"), ("paragraph", 3, "\ta\u2003b\nc "), ("heading", 4, "bibliography"), ("heading", 4, "Annex C")]
    rows = blocked(spark, odd).union(blocked(spark, [("paragraph", 9, " one two"), ("heading", 9, "2.1 ?!")]).withColumn("doc_id", F.lit(2).cast("long")))
    listed = lambda built: sorted(map(str, sections.manifest(built).collect()))
    lean = sections.build(rows, texts=False)
    assert listed(lean) == listed(sections.build(rows)) and len(listed(lean)) == 5 and "text" not in lean.columns
    assert [r.word_count for r in lean.orderBy("doc_id", "section_no").collect()] == [11, 1, 2, 2, 2]
    plan = queries()["section_manifest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(o," not in plan


def test_topics(spark):
    rows = blocked(spark, [("paragraph", 1, "a"), ("heading", 2, "H"), ("paragraph", 2, "b")]).withColumn("block_id", F.concat(F.lit("b"), F.col("block_no").cast("string")))
    assert [(r.topic_id, r.title, r.page, r.block_ids) for r in sections.topics(rows).orderBy("topic_no").collect()] == [("topic_default", "Introduction / Unsorted", 1, ["b0"]), ("b1", "H", 2, ["b2"])]


def test_toc(spark):
    words = "these are ten words of a paragraph that ends contents here"
    text = "\n".join(["Title", "Contents", *[f"Part {k} {k}" for k in range(6)], "stray", words, "rest"])
    docs = spark.createDataFrame([(1, text), (2, "Contents\na 1"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in toc.drop_from_text(docs).collect()} == {1: f"Title\nstray\n{words}\nrest", 2: "Contents\na 1", 3: ""}


def test_spoken_blocks(spark):
    rows = blocked(spark, [("heading", 1, "Contents"), ("paragraph", 1, "Part 1"), ("paragraph", 5, "See [[TABLE|t1|Table 1]]"), ("paragraph", 5, "12"), ("paragraph", 6, "[TABLE:t2] Table 2")])
    told = spark.createDataFrame([(1, 0, "t1", "It shows."), (1, 1, "t1", "It shows x."), (2, 0, "t2", "Of another document."), (1, 0, None, "x")], "doc_id long, n int, id string, text string")
    assert [r.text for r in spoken_blocks(rows, told, order="n").orderBy("block_no").collect()] == ["See Table 1. It shows x.", "Table 2. This is a table. Please provide a short explanation for table id t2."]


def test_ssml_and_block_chunks(spark):
    rows = blocked(spark, [("heading", 1, "Top"), ("paragraph", 1, "a" * 50), ("paragraph", 1, "b")])
    assert [r.n_blocks for r in chunks.ssml_chunks(rows, longest=120).orderBy("chunk_no").collect()] == [1, 2]
    assert [r.text for r in chunks.block_chunks(rows, longest=40).orderBy("chunk_no").collect()] == ["Top", "a" * 50, "b"]


def test_overlay_tombstone(spark):
    a = spark.createDataFrame([(1, "o1"), (2, "o2"), (3, "o3")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "n1"), (2, "n2")], "doc_id long, text string")
    c = spark.createDataFrame([(1, "u1"), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in overlay.overlay(a, b, c, keys=["doc_id"]).collect()} == {1: "u1", 2: "n2"}
    assert overlay.first_nonempty(c.where("false"), b).count() == 2
    with pytest.raises(KeyError):
        overlay.block_of(a.withColumn("block_id", F.lit("x")), "y")


def test_audio(spark):
    good = spark.createDataFrame([(1, 2, "p", bytearray(b"b")), (1, 1, "p", bytearray(b"a"))], "doc_id long, part_no int, params string, frames binary")
    assert bytes(overlay.merged_audio(good).first().frames) == b"ab"
    with pytest.raises(Exception, match="different parameters"):
        overlay.merged_audio(good.withColumn("params", F.col("part_no").cast("string"))).collect()


def test_tables(spark):
    caps = spark.createDataFrame([(1, 1, "Table 3 — Sizes", [72.0, 100.0, 200.0, 110.0], 600.0, 800.0), (1, 2, "table 4", [72.0, 700.0, 200.0, 710.0], 600.0, 800.0), (1, 2, "In table 4", [0.0] * 4, 600.0, 800.0)], "doc_id long, page int, text string, bbox array<double>, page_w double, page_h double")
    drawn = [(1, 1, k, [100.0, 200.0 + k, 500.0, 201.0 + 2 * k], 600.0, 800.0) for k in range(30)] + [(1, 1, 99, [0.0, 0.0, 1.0, 1.0], 600.0, 800.0)]
    regions = tables.ruled_regions(spark.createDataFrame(drawn, "doc_id long, page int, drawing_no long, bbox array<double>, page_w double, page_h double"))
    assert regions.first().bbox == [100.0, 200.0, 500.0, 259.0]
    found = tables.placed(tables.captions(caps), regions).orderBy("page").collect()
    assert [(r.table_id, r.hit_id, r.bbox) for r in found] == [("T3", "T3_P1", [100.0, 200.0, 500.0, 259.0]), ("T4", "T4_P2", [0.0, 710.0, 600.0, 800.0])]


def test_table_index(spark):
    rows = blocked(spark, [("table", 2, "x"), ("paragraph", 1, "[[TABLE|a|Table 2]] [[TABLE|a|Table 2]]")]).withColumn("table_id", F.when(F.col("type") == "table", "T2")).withColumn("caption", F.when(F.col("type") == "table", "Table 2 (continued)"))
    r = tables.index(rows).first()
    assert (r.table_id, r.caption, [o.page for o in r.occurrences]) == ("T2", "Table 2 (continued)", [1, 2])


def test_formula_cascade(spark):
    data = [(1, 1, 0, "a = b", [100.0, 100.0, 300.0, 110.0]), (1, 1, 1, "(3)", [500.0, 100.0, 520.0, 110.0]), (1, 2, 0, "x = y", [100.0, 100.0, 300.0, 110.0]), (1, 3, 0, "plain", [100.0, 100.0, 300.0, 110.0])]
    rows = spark.createDataFrame(data, "doc_id long, page int, line_no long, text string, bbox array<double>").withColumn("page_w", F.lit(600.0))
    found = formulas.with_ids(formulas.page_regions(rows)).orderBy("seq").collect()
    assert [(r.page, r.tier, r.formula_id, r.bbox) for r in found] == [(1, 0, "F3_p1_1", [100.0, 100.0, 520.0, 110.0]), (2, 1, "F2_p2_2", [100.0, 100.0, 300.0, 110.0])]


def test_formula_lines_fold(spark):
    data = [(1, 1, n, "a / b", [100.0, y, 300.0, y + 10]) for n, y in enumerate((100.0, 115.0, 145.0, 300.0))]
    rows = spark.createDataFrame(data, "doc_id long, page int, line_no long, text string, bbox array<double>").withColumn("page_w", F.lit(600.0))
    assert [r.bbox for r in formulas.formula_lines(rows).orderBy("line_no").collect()] == [[100.0, 100.0, 300.0, 155.0], [100.0, 300.0, 300.0, 310.0]]


def test_recognition_and_injection(spark):
    rows = spark.createDataFrame([(1, 2, 0, "raw", "??", "x=1")], "doc_id long, page int, line_no long, text string, first string, second string").withColumn("bbox", F.array(F.lit(1.0)))
    done = formulas.with_ids(formulas.recognised(rows, "first", "second"))
    r = done.first()
    assert (r.latex, r.provider, r.spoken, r.formula_id) == ("x=1", "second", "x equals 1", "F1_p2_1")
    told = formulas.narrations(done, spark.createDataFrame([], "doc_id long, id string, text string"))
    sec = spark.createDataFrame([(1, 0, 1, 3, "Body."), (1, 1, 4, 5, "Other.")], "doc_id long, section_no int, page_start int, page_end int, text string")
    out = normalize_sections(sec, told).orderBy("section_no").collect()
    assert [r.text for r in out] == ["Body.\n\nFormulas in this section:\n- F1_p2_1 (page 2): x equals 1", "Other."]
    assert [r.text for r in formulas.inject(blocked(spark, [("paragraph", 1, "a")]), done).orderBy("block_no").collect()] == ["a", "[[FORMULA|F1_p2_1|]]"]


def test_sources(spark, tmp_path):
    assert sources.json_rows(spark, str(tmp_path / "none.json"), sources.RULES).count() == 0
    (tmp_path / "rules.json").write_text('{"exact": ["a"], "regex": ["b"]}')
    assert sources.remove_rules(spark, str(tmp_path / "rules.json")) == {"exact": ["a"], "regex": ["b"]}
    (tmp_path / "map.json").write_text('{"T1": "x"}')
    assert [tuple(r) for r in sources.json_map(spark, str(tmp_path / "map.json")).collect()] == [("T1", "x")]
    folder = tmp_path / "texts"
    folder.mkdir()
    for name, text in (("02_b.txt", "b"), ("10_c.txt", "c"), ("01_a.txt", " ")):
        (folder / name).write_text(text)
    assert [r.name for r in sources.sections(spark, str(folder)).collect()] == ["02_b.txt", "10_c.txt"]
    (tmp_path / "spans.json").write_text('[{"page": 1, "text": " x ", "font": "Arial-BoldOblique"}, {"page": 2, "text": " "}, {"page": 3, "text": "y"}]')
    assert [(r.text, r.bold, r.italic) for r in sources.spans(spark, str(tmp_path / "spans.json"), 2).collect()] == [("x", True, True)]
    assert sources.write_missing(spark.range(1), str(tmp_path / "out")) and not sources.write_missing(spark.range(1), str(tmp_path / "out"))


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    rows = streaming.chunk_stream(streaming.inbox(spark, str(tmp_path / "in"), "doc_id long, text string"))
    streaming.to_parquet(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text").collect()] == [(1, "a\n\nb")]


def test_spans_to_sections(spark):
    rows = [(1, 0, "1 Scope", 72, 60, 20), (1, 1, "Some text here.", 72, 100, 11), (1, 2, "Table 1 - Sizes", 72, 300, 11), (1, 3, "inside the table", 72, 330, 11)]
    drawn = spark.createDataFrame([], "doc_id long, page int, drawing_no long, bbox array<double>, page_w double, page_h double")
    _, built = documents_to_sections(spans(spark, rows), drawn)
    text = built.first().text
    assert "Some text here." in text and "[[TABLE|T1|Table 1 - Sizes]]" in text and "inside" not in text


def drawn_on(spark, pages):
    """Boxes of each page in drawing order, on pages of 600 x 800."""
    rows = [(1, p, k, [float(v) for v in b], 600.0, 800.0) for p, boxes in pages.items() for k, b in enumerate(boxes)]
    return spark.createDataFrame(rows, "doc_id long, page int, drawing_no long, bbox array<double>, page_w double, page_h double")


def test_ruled_regions_of_many_pages(spark):
    grid = lambda x, y, n=20: [(x + 20 * (k % 10), y + 30 * (k // 10), x + 20 * (k % 10) + 20, y + 30 * (k // 10) + 30) for k in range(n)]
    frame = [(0, 0, 600, 800)] * 20
    found = tables.ruled_regions(
        drawn_on(
            spark,
            {
                1: grid(100, 100),
                2: grid(100, 100, 17),  # too few
                3: grid(300, 400) + grid(50, 100),  # two apart, from the top down
                4: frame,  # around the page
                5: [(10, 10, 12, 12)] * 20,  # too small
                6: grid(100, 100) + grid(100, 175),  # a gap of 15 between them: clusters of their own, too far to join
                7: grid(100, 100) + grid(100, 170),  # a gap of 10: one cluster by padding
            },
        )
    ).collect()
    by_page = {}
    for r in found:
        by_page.setdefault(r.page, []).append([int(v) for v in r.bbox])
    assert by_page == {1: [[100, 100, 300, 160]], 3: [[50, 100, 250, 160], [300, 400, 500, 460]], 6: [[100, 100, 300, 160], [100, 175, 300, 235]], 7: [[100, 100, 300, 230]]}


def test_back_references_in_rules(spark):
    df = spark.createDataFrame([("xx",), ("abab",), ("abcd",)], "text string")
    assert [r.text for r in lines.remove_by_rules(df, {"regex": [r"^(x)\1$", r"^(ab)\1$"]}).collect()] == ["abcd"]


def test_narrated_formulas(spark):
    from lectern.plans import narrated_formulas

    found = spark.createDataFrame([(1, 1, "paragraph", 1, None, "words"), (1, 2, "formula", 1, [0.0, 0.0, 9.0, 9.0], "(3)"), (1, 3, "formula", 2, [0.0, 0.0, 9.0, 9.0], "x = 1")], "doc_id long, block_no int, type string, page int, bbox array<double>, text string")
    rows = spark.createDataFrame([], "doc_id long, page int, line_no long, text string, bbox array<double>, page_w double, page_h double")
    seen = spark.createDataFrame([(1, "F3_p1_1", None, "a+b"), (1, "F2_p2_2", "no image", None)], "doc_id long, formula_id string, error string, ocr string")
    made, tokens, said = narrated_formulas(found, rows, seen, providers=("ocr",))
    assert [(r.formula_id, r.latex, r.provider, r.error) for r in made.orderBy("page").collect()] == [("F3_p1_1", "a+b", "ocr", None), ("F2_p2_2", "x = 1", "text", "no image")]
    assert [r.text for r in tokens.where("block_no > 3").collect()] == ["[[FORMULA|F3_p1_1|]]"] and [r.formula_id for r in said.collect()] == ["F3_p1_1"]


def test_command_line(spark, tmp_path):
    from lectern.__main__ import main

    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "00_a.txt").write_text("One line of 5 kg. Another.")
    (tmp_path / "blocks.json").write_text('[{"page": 1, "type": "heading", "text": "1 Scope of it"}, {"page": 1, "type": "paragraph", "text": "body"}]')
    for command, given in (("chunks", "texts"), ("ssml", "texts"), ("normalize", "texts"), ("sections", "blocks.json"), ("blocks", "blocks.json")):
        main([command, str(tmp_path / given), str(tmp_path / command)], spark)
        assert spark.read.json(str(tmp_path / command)).count() > 0, command
    assert "5 kilograms" in spark.read.json(str(tmp_path / "normalize")).first().text


def test_command_line_on_many_documents(spark, tmp_path):
    """A JSON file is a document, and so is a folder of texts."""
    from lectern.__main__ import main

    for name in ("a", "b"):
        (tmp_path / "blocks").mkdir(exist_ok=True)
        (tmp_path / "blocks" / f"{name}.json").write_text('[{"page": 1, "type": "heading", "text": "1 Scope of %s"}, {"page": 1, "type": "paragraph", "text": "body %s"}]' % (name, name))
        (tmp_path / "texts" / name).mkdir(parents=True)
        (tmp_path / "texts" / name / "01_x.txt").write_text(f"Some text of {name}.")
    for command, given in (("sections", "blocks"), ("blocks", "blocks"), ("chunks", "texts"), ("normalize", "texts"), ("ssml", "texts")):
        main([command, str(tmp_path / given), str(tmp_path / f"out-{command}")], spark)
        found = spark.read.json(str(tmp_path / f"out-{command}")).collect()
        assert {r["doc"] for r in found} == {"a", "b"}, command
    assert {(r["doc"], r["title"]) for r in spark.read.json(str(tmp_path / "out-sections")).collect()} == {("a", "1 Scope of a"), ("b", "1 Scope of b")}


def test_boxed_lines(spark):
    """Order by page, height and left edge; a blank span lends its box and size; lines without text or box go."""
    rows = [(1, 0, "right", 300, 50, 10), (1, 1, "left", 72, 50, 10), (1, 2, " ", 20, 90, 30), (1, 2, "wide", 72, 95, 10), (1, 3, " ", 72, 200, 10), (2, 0, "next", 72, 10, 10)]
    df = spans(spark, rows)
    lost = df.where("span_no = 0").withColumns({"line_no": F.lit(9), "bbox": F.lit(None).cast("array<double>"), "text": F.lit("no box")})
    found = lines.boxed_lines(df.unionByName(lost)).orderBy("page", "line_no").collect()
    assert [(r.page, r.line_no, r.text, r.bbox) for r in found] == [(1, 1, "left", [72.0, 50.0, 172.0, 60.0]), (1, 2, "right", [300.0, 50.0, 400.0, 60.0]), (1, 3, "wide", [20.0, 90.0, 172.0, 105.0]), (2, 1, "next", [72.0, 10.0, 172.0, 20.0])]
    assert found[2].avg_size == 20.0


def test_document_keys(spark):
    files = spark.createDataFrame([("a/x.pdf",), ("b/x.pdf",), ("a/x.pdf",)], "path string")
    keys = [r.doc_key for r in sources.with_doc_ids(files).collect()]
    assert keys[0] == keys[2] != keys[1] and all(len(k) == 10 and int(k, 16) >= 0 for k in keys)
