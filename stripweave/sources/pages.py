"""Crawled pages: element rows from their html."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripweave.session import ship

#: Elements without an end tag.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
FIELDS = pa.schema([
    ("page_id", pa.int64()), ("idx", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
    ("parent_idx", pa.int32()), ("parent_id", pa.string()), ("parent_classes", pa.list_(pa.string())), ("depth", pa.int32()), ("text", pa.string()),
])
SCHEMA = "page_id long, idx int, tag string, id string, classes array<string>, attrs map<string,string>, parent_idx int, parent_id string, parent_classes array<string>, depth int, text string"


#: Elements and characters of html that are held before their rows leave a task. A batch of pages makes many times its size of them.
ROWS, CHARACTERS = 2000, 1 << 20


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in reversed(attrs)}  # of repeated attributes the first counts
        above = self.open[-1] if self.open else None
        row = {
            "idx": len(self.rows), "tag": tag, "id": own.get("id", ""), "classes": own.get("class", "").split(), "attrs": own, "parent_idx": above["idx"] if above else None,
            "parent_id": above["id"] if above else "", "parent_classes": above["classes"] if above else [], "depth": len(self.open) + 1, "text": "",
        }
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(row)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1]["text"] += data


def elements_of(html: str) -> list[dict]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.rows


def html_elements(pages: DataFrame, tags: tuple[str, ...] | None = None) -> DataFrame:
    """One row per element of each page in document order, of the given tags only if there are any. Null html has no elements; broken html gives
    what can be read."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                text = html.as_py()
                rows += ({"page_id": page.as_py(), **e, "attrs": list(e["attrs"].items())} for e in elements_of(text) if tags is None or e["tag"] in tags)
                size += len(text)
                if len(rows) >= ROWS or size >= CHARACTERS:
                    yield pa.RecordBatch.from_pylist(rows, FIELDS)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, FIELDS)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, SCHEMA)
