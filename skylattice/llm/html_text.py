"""Main text of web pages: leaf blocks, labelled by the recurrent labeller."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import leaves
from .common import SLICE, ship, slices, tidy
from .labeller import Labeller, label, trained

TEXT = "page_id long, url string, text string, n_chars long"


def main_text(pages: list[str | None], model: Labeller) -> list[str]:
    found = [leaves(p) for p in pages]
    return ["\n".join(leaf.text for leaf, main in zip(page, good, strict=True) if main) for page, good in zip(found, label(model, found), strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of pages(page_id, url, html).

    Null or empty html, or a page without main blocks: an empty text. Null ids and urls, and repeated
    rows, are passed on as they are. The whole page is one sequence, however long. A script or style without an end goes on to the page's end; other
    unseen elements without one are read as if their tag were not there; a slash at a tag's end closes svg and math alone. An empty table gives an empty
    result. Other columns are ignored."""
    ship(pages.sparkSession)
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, size=2 * SLICE):
                texts = [t.encode("utf-8", "replace").decode() for t in main_text(part.column(2).to_pylist(), model)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(tidy(run), TEXT)
