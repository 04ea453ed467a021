"""Documents from records, and what a rendering run has to write, move or leave alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import checkpoint

MARK = "managed: true"


def document(fields: dict[str, Column], title: Column, body: Column) -> Column:
    """A Markdown document with front matter, heading and body."""
    return F.concat_ws("\n", text.front_matter(fields), F.concat(F.lit("\n# "), text.heading(title), F.lit("\n")), F.coalesce(body, F.lit("")))


def sealed(doc: Column) -> Column:
    """A document with the hash of the rest of it in its front matter."""
    line = F.concat(F.lit(f"---\n{MARK}\nrender_hash: "), F.sha2(doc, 256), F.lit("\n"))
    return F.concat(line, F.substr(doc, F.lit(5)))


def seal_of(doc: Column) -> Column:
    """The hash that a document carries; empty if it carries none."""
    return F.regexp_extract(doc, rf"^---\n{MARK}\nrender_hash: ([0-9a-f]{{64}})\n", 1)


def is_untouched(doc: Column) -> Column:
    """Whether a document is as it was rendered."""
    bare = F.concat(F.lit("---\n"), F.regexp_replace(doc, rf"^---\n{MARK}\nrender_hash: [0-9a-f]{{64}}\n", ""))
    return F.coalesce((seal_of(doc) != "") & (F.sha2(bare, 256) == seal_of(doc)), F.lit(False))


def actions(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """item_id, path and action of a run.

    ``wanted`` and ``existing`` hold item_id, path and document, one row an item.  Written:
    new or changed and untouched since; moved: untouched and under another path; skipped: as
    wanted; conflict: changed by someone else; removed: untouched and no longer wanted.
    """
    w = wanted.select("item_id", F.col("path").alias("new_path"), F.col("document").alias("new"))
    e = existing.select("item_id", F.col("path").alias("old_path"), F.col("document").alias("old"))
    both = w.join(e, "item_id", "full")
    action = (
        F.when(F.col("old").isNull(), "written")
        .when(~is_untouched(F.col("old")), F.when(F.col("new").isNotNull() & (F.col("old") == F.col("new")) & (F.col("old_path") == F.col("new_path")), "skipped").otherwise("conflict"))
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old_path") != F.col("new_path"), "moved")
        .when(F.col("old") == F.col("new"), "skipped")
        .otherwise("written")
    )
    return both.select("item_id", F.coalesce("new_path", "old_path").alias("path"), action.alias("action"))


def write_documents(df: DataFrame, root: str) -> DataFrame:
    """Writes (path, document) rows below a root that all executors share, each file at once; path and outcome of each.

    Paths are made safe, so none leaves the root.  A file that is there already is overwritten only
    if it is as it was rendered (``written``); one that is equal is ``skipped``, and one that someone has
    changed, or that was not rendered, is a ``conflict`` and stays.
    """

    def outcome(target: str, document: str) -> str:
        import hashlib
        import os
        import re
        import tempfile

        if os.path.exists(target):
            with open(target, encoding="utf-8", errors="replace", newline="") as f:
                old = f.read()
            if old == document:
                return "skipped"
            head = re.match(rf"---\n{MARK}\nrender_hash: ([0-9a-f]{{64}})\n", old)
            if head is None or hashlib.sha256(("---\n" + old[head.end() :]).encode()).hexdigest() != head[1]:
                return "conflict"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        handle, name = tempfile.mkstemp(dir=os.path.dirname(target))
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(document)
        os.replace(name, target)
        return "written"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for b in batches:
            paths = b.column(0).to_pylist()
            done = [outcome(os.path.join(root, p), d or "") if p else "conflict" for p, d in zip(paths, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], names=["path", "outcome"])

    safe = df.select(text.safe_relative_path("path").alias("path"), "document")
    return checkpoint(safe.mapInArrow(put, "path string, outcome string"))  # written once, whatever is done with the report
