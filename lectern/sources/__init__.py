"""Readers and writers: spans, blocks, maps, text sections, page images, audio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.filters import bold, italic
from lectern.functions.text import strip

SPAN = "page int, text string, font string, size double, bold boolean, italic boolean, bbox array<double>, page_w double, page_h double"
BLOCK = "page int, type string, text string, y double, bbox array<double>, table_id string, hit_id string, caption string"
FORMULA = "formula_id string, page int, bbox array<double>, image string, latex string, provider string, spoken string, ssml string"
RULES = "exact array<string>, regex array<string>"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array (or lines of objects) with a declared schema; no rows where the file is missing or no JSON."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    names = [x.split()[0] for x in schema.split(", ")]
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where("_corrupt_record is null").select(*names)


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of texts as ``id, text``; no rows where the file is missing or no such object."""
    if not exists(spark, path):
        return spark.createDataFrame([], "id string, text string")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "text"))


def remove_rules(spark: SparkSession, path: str) -> dict:
    row = json_rows(spark, path, RULES).first()
    return {"exact": list(row["exact"] or []) if row else [], "regex": list(row["regex"] or []) if row else []}


def spans(spark: SparkSession, path: str, max_pages: int | None = None) -> DataFrame:
    """Layout spans with ``span_no``; bold and italic from the font's name where they are not given; blank ones go.

    The limit on pages reaches the reader, which makes no rows of later pages.
    """
    rows = json_rows(spark, path, SPAN)
    rows = rows if max_pages is None else rows.where(F.col("page") <= max_pages)
    rows = rows.withColumn("text", strip(F.col("text"))).where("text <> ''").withColumn("span_no", F.monotonically_increasing_id())
    return rows.withColumn("bold", F.coalesce("bold", bold(F.col("font")))).withColumn("italic", F.coalesce("italic", italic(F.col("font"))))


def document_rows(spark: SparkSession, path: str, schema: str, where: str | None = None) -> DataFrame:
    """JSON files (an array or lines of objects each) with a declared schema and ``doc, doc_id``: a file is a document, named as it is without ``.json``.

    ``path`` is a file, a folder or a pattern; what is no JSON has no rows. The condition ``where`` reaches the reader.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    rows = rows if where is None else rows.where(where)
    rows = rows.withColumn("doc", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1))
    return rows.select(*names, "doc", F.xxhash64("doc").alias("doc_id"))


def document_spans(spark: SparkSession, folder: str, max_pages: int | None = None) -> DataFrame:
    """``spans`` of every JSON file in ``folder``, with ``doc, doc_id``; the limit on pages reaches the reader."""
    rows = document_rows(spark, folder, SPAN, None if max_pages is None else f"page <= {int(max_pages)}")
    rows = rows.withColumn("text", strip(F.col("text"))).where("text <> ''").withColumn("span_no", F.monotonically_increasing_id())
    return rows.withColumn("bold", F.coalesce("bold", bold(F.col("font")))).withColumn("italic", F.coalesce("italic", italic(F.col("font"))))


def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Text files in folders below ``folder``, a folder a document: ``doc, doc_id, section_no, name, text``; files of ``folder`` itself are a document of its name."""
    rows = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select("value", F.regexp_extract_all(F.col("_metadata.file_path"), F.lit("[^/]+"), F.lit(0)).alias("at"))
    name, doc = F.element_at("at", -1), F.element_at("at", -2)
    number = F.coalesce(F.regexp_extract(name, r"^(\d+)_", 1).try_cast("int"), F.lit(999999))
    return rows.select(doc.alias("doc"), F.xxhash64(doc).alias("doc_id"), number.alias("section_no"), name.alias("name"), F.col("value").alias("text")).where(strip(F.col("text")) != "")


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """One text file a section: ``section_no, name, text`` in order of leading number and name; blank ones go."""
    rows = spark.read.text(folder, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("name"))
    number = F.coalesce(F.regexp_extract("name", r"^(\d+)_", 1).try_cast("int"), F.lit(999999))
    return rows.select(number.alias("section_no"), "name", F.col("value").alias("text")).where(strip(F.col("text")) != "").orderBy("section_no", "name")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Files with ``sha256`` of their content, the key of the recognition cache."""
    return spark.read.format("binaryFile").load(folder).select("path", F.sha2("content", 256).alias("sha256"), "content")


def pdf_spans(spark: SparkSession, folder: str, max_pages: int | None = None) -> DataFrame:
    """Spans of PDF files, by an optional library; one file is one task's unit."""
    import importlib.util

    if importlib.util.find_spec("fitz") is None:
        raise RuntimeError("reading PDF files needs the optional package PyMuPDF")

    def read(batches):
        import fitz
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                rows = []
                for page in fitz.open(stream=content, filetype="pdf"):
                    if max_pages is not None and page.number >= max_pages:
                        break
                    for b, block in enumerate(page.get_text("dict")["blocks"]):
                        for n, line in enumerate(block.get("lines", [])):
                            for k, s in enumerate(line["spans"]):
                                rows.append((path, page.number + 1, b, n, k, s["text"], s["font"], float(s["size"]), list(map(float, s["bbox"])), page.rect.width, page.rect.height))
                yield pd.DataFrame(rows, columns=["doc", "page", "block_no", "line_no", "span_no", "text", "font", "size", "bbox", "page_w", "page_h"])

    rows = spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(read, "doc string, page int, block_no int, line_no int, span_no int, text string, font string, size double, bbox array<double>, page_w double, page_h double")
    return rows.withColumns({"doc_id": F.xxhash64("doc"), "bold": bold(F.col("font")), "italic": italic(F.col("font"))})


def with_doc_ids(files: DataFrame, path: str = "path") -> DataFrame:
    """``doc_key``: ten hexadecimal digits of a hash of the path, the same in every run, also the name of the document's folder."""
    return files.withColumn("doc_key", F.substring(F.sha2(F.col(path), 256), 1, 10))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_texts(rows: DataFrame, path: str, *, text: str = "text", by: list[str]) -> None:
    """One folder of text a value of ``by``, older output replaced."""
    rows.select(*by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(*by).text(path, lineSep="\n")


def write_missing(rows: DataFrame, path: str) -> bool:
    """Write unless the path exists; whether it was written."""
    if exists(rows.sparkSession, path):
        return False
    rows.write.parquet(path)
    return True
