"""Sections and chunks of documents whose blocks arrive over time, with the open one kept as state by document.

Blocks of a document carry ``block_no`` from 0 without gaps, and the last one
says so in ``last``. Whatever order they come in and however they are split over
micro-batches, they are taken in their order: blocks that are ahead wait in the
state. A document that stays silent is closed after a timeout with what it has;
blocks that come later begin anew behind a gap.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions import filters as f
from lectern.functions.text import clean_for_tts, strip
from lectern.operators.chunks import TEXT_CHARS
from lectern.operators.sections import heading_names, table_fields

STATE = "state string"


class Sections:
    """Blocks to sections: an open section ends at the next heading."""

    schema = "doc_id long, section_no int, id string, title string, page_start int, page_end int, text string"
    columns = ("head", "id", "title", "page", "text")

    def __init__(self) -> None:
        self.open: dict | None = None
        self.done = 0

    def add(self, block: dict) -> Iterator[tuple]:
        if block["text"] == "":
            return
        if block["head"] or self.open is None:
            yield from self.end()
            front = not block["head"]
            self.open = {"id": "00_front_matter" if front else block["id"], "title": "Front matter" if front else block["title"], "start": 1 if front else block["page"], "end": None, "texts": []}
        own = self.open
        own["texts"].append(block["text"])
        own["end"] = block["page"] if own["end"] is None else max(own["end"], block["page"])

    def end(self) -> Iterator[tuple]:
        if self.open is not None:
            own, self.open = self.open, None
            yield (self.done, own["id"], own["title"], own["start"], max(own["start"], own["end"]), "\n\n".join(own["texts"]))
            self.done += 1


class Chunks:
    """Pieces to chunks, packed while they fit."""

    schema = "doc_id long, chunk_no int, text string"
    columns = ("piece",)

    def __init__(self, longest: int = TEXT_CHARS) -> None:
        self.longest, self.open, self.done = longest, "", 0

    def add(self, block: dict) -> Iterator[tuple]:
        if self.open and len(self.open) + len(block["piece"]) > self.longest:
            yield from self.end()
        self.open += block["piece"]

    def end(self) -> Iterator[tuple]:
        if self.open.strip():
            self.done += 1
            yield (self.done, self.open.strip())
        self.open = ""


def _keyed(blocks: DataFrame, make, columns: tuple[str, ...], schema: str, timeout: str | None) -> DataFrame:
    """Run a fold over each document's blocks in their order, its fields and the waiting blocks being the state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"next": 0, "waiting": {}, "last": None, "fold": {}}
        fold = make()
        vars(fold).update(kept["fold"])
        waiting, out = kept["waiting"], []
        for frame in frames:
            for b in frame.to_dict("records"):
                if b["block_no"] >= kept["next"]:
                    waiting[str(b["block_no"])] = {c: b[c] for c in columns}
                    kept["last"] = b["block_no"] if b["last"] else kept["last"]
        if state.hasTimedOut:
            for n in sorted(map(int, waiting)):
                out += fold.add(waiting.pop(str(n)))
                kept["next"] = n + 1
            out += fold.end()
        while str(kept["next"]) in waiting:
            out += fold.add(waiting.pop(str(kept["next"])))
            kept["next"] += 1
        closed = kept["last"] is not None and kept["next"] > kept["last"]
        if closed:
            out += fold.end()
        state.update((json.dumps(kept | {"fold": vars(fold)}),))
        if timeout and not state.hasTimedOut and not closed:
            state.setTimeoutDuration(int(pd.Timedelta(timeout).total_seconds() * 1000))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=[c.split()[0] for c in schema.split(", ")])

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return blocks.select("doc_id", "block_no", F.coalesce("last", F.lit(False)).alias("last"), *columns).groupBy("doc_id").applyInPandasWithState(run, schema, STATE, "append", kind)


def section_stream(blocks: DataFrame, *, timeout: str | None = None) -> DataFrame:
    """``operators.sections.build`` of a stream of blocks (``doc_id, block_no, last, type, page, text``), without the lists of tables."""
    for name in ("table_id", "caption"):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast("string"))
    rows = table_fields(blocks.withColumn("text", strip(F.coalesce("text", F.lit("")))))
    rows = rows.withColumn("head", (F.col("type") == "heading") & f.section_heading(F.col("text"))).withColumn("name", heading_names(F.col("text")))
    return _keyed(rows.select("*", "name.id", "name.title"), Sections, Sections.columns, Sections.schema, timeout)


def block_chunk_stream(blocks: DataFrame, *, longest: int = TEXT_CHARS, timeout: str | None = None) -> DataFrame:
    """``operators.chunks.block_chunks`` of a stream of blocks (``doc_id, block_no, last, type, text``)."""
    rows = blocks.withColumn("t", clean_for_tts(F.col("text")))
    before = F.when(F.col("type") == "heading", F.lit("\n\n")).otherwise(F.lit(""))
    rows = rows.withColumn("piece", F.when(F.col("t") == "", F.lit("")).otherwise(F.concat(before, "t", F.lit("\n\n"))))
    return _keyed(rows, lambda: Chunks(longest), Chunks.columns, Chunks.schema, timeout)
