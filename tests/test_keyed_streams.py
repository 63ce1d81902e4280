"""Streams that carry open sections and chunks give what a batch does, and committed output survives a writer that dies."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lectern import sources
from lectern.operators import chunks, sections
from lectern.sources.committed import CommittedOutput
from lectern.streaming import keyed

BLOCK = "doc_id long, block_no int, type string, page int, text string, last boolean"


def some_blocks(seed, documents=6):
    r = random.Random(seed)
    rows = []
    for d in range(documents):
        n = r.choice([1, 2, 7, 30])
        for k in range(n):
            kind = r.choice(["paragraph", "paragraph", "heading", "table"])
            text = {"heading": f"{k + 1} Part {k}", "table": f"[TABLE:T{k}] Table {k}"}.get(kind, r.choice(["", " ", "some <b>words</b> of text " * r.randrange(1, 9)]))
            rows.append((d, k, kind, 1 + k // 4, text, k == n - 1))
    return rows


def streamed(spark, tmp_path, batches, transform):
    """What a stream gives for batches of blocks, one micro-batch each."""
    folder, out = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, BLOCK).coalesce(1).write.mode("append").parquet(str(folder))
        query = transform(spark.readStream.schema(BLOCK).parquet(str(folder))).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None, k
    return spark.read.parquet(str(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_sections_of_a_stream(spark, tmp_path, seed):
    rows = some_blocks(seed)
    whole = sections.build(spark.createDataFrame(rows, BLOCK))
    r = random.Random(seed)
    r.shuffle(rows)
    cuts = sorted(r.sample(range(1, len(rows)), 2))
    found = streamed(spark, tmp_path, [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)], keyed.section_stream)
    columns = ["doc_id", "section_no", "id", "title", "page_start", "page_end", "text"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))


def test_chunks_of_a_stream(spark, tmp_path):
    rows = some_blocks(3)
    whole = chunks.block_chunks(spark.createDataFrame(rows, BLOCK), longest=120)
    found = streamed(spark, tmp_path, [rows[0::3], rows[2::3], rows[1::3]], lambda s: keyed.block_chunk_stream(s, longest=120))
    assert sorted(map(tuple, found.select("doc_id", "chunk_no", "text").collect())) == sorted(map(tuple, whole.select("doc_id", "chunk_no", "text").collect()))


def test_a_silent_document_is_closed(spark, tmp_path):
    """A document without its last block comes out after the timeout, the block behind the gap, too."""
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, "paragraph", 1, "one", False), (1, 2, "paragraph", 1, "three", False)], BLOCK).coalesce(1).write.parquet(folder)
    stream = keyed.block_chunk_stream(spark.readStream.schema(BLOCK).parquet(folder), timeout="2 seconds")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and not (rows := spark.read.schema(keyed.Chunks.schema).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []):
            time.sleep(1)
    finally:
        query.stop()
    assert [tuple(r) for r in rows] == [(1, 1, "one\n\nthree")]


def test_committed_output(spark, tmp_path, monkeypatch):
    out = CommittedOutput(spark, str(tmp_path / "texts"))
    table = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, chunk_no int, text string")
    read = lambda: sorted(map(tuple, out.read().select("doc_id", "text").collect()), key=str)
    with pytest.raises(FileNotFoundError):
        out.read()
    assert out.write(table((1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "n")), "first")
    assert not out.write(table((1, 1, "never")), "first")
    assert read() == [(1, "a"), (1, "b"), (2, "c"), (None, "n")]

    with monkeypatch.context() as m:  # the writer dies between the rows and the record
        m.setattr(CommittedOutput, "_put", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            out.write(table((1, 1, "A")), "second")
    assert read() == [(1, "a"), (1, "b"), (2, "c"), (None, "n")]
    assert out.sweep() == ["runs/second", "commits/.second"]
    assert out.write(table((1, 1, "A")), "second")
    assert read() == [(1, "A"), (2, "c"), (None, "n")]
    assert out.write(table((2, 1, "C")).withColumn("more", F.lit(1)), "third", covers=spark.createDataFrame([(1,), (None,)], "doc_id long"))
    assert read() == [(2, "C")] and out.read().columns == ["doc_id", "chunk_no", "text", "more"]
    assert out.sweep() == ["runs/first", "runs/second"] and read() == [(2, "C")]
    assert out.write(table(), "fourth", covers=spark.createDataFrame([(2,)], "doc_id long")) and read() == []
    with pytest.raises(ValueError, match="not a name"):
        out.write(table(), "../x")


def test_spans_of_many_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"page": 1, "text": " x ", "font": "Arial-BoldOblique"}, {"page": 2, "text": " "}, {"page": 3, "text": "y"}]')
    (tmp_path / "b.json").write_text('{"page": 1, "text": "z"}')
    (tmp_path / "c.json").write_text('{"page": 1, "te')
    found = sources.document_spans(spark, str(tmp_path), 2)
    assert sorted((r.doc, r.text, r.bold) for r in found.collect()) == [("a", "x", True), ("b", "z", False)]
    assert len({r.doc_id for r in found.collect()}) == 2
    for rows in (found, sources.spans(spark, str(tmp_path / "a.json"), 2)):
        plan = rows.select("text")._jdf.queryExecution().executedPlan().toString()
        assert "LessThanOrEqual(page,2)" in plan and "ReadSchema: struct<page:int,text:string" in plan and "size" not in plan
