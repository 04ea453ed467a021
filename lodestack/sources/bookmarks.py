"""Exports of bookmarks: Atom and RSS by their root, Netscape HTML, search responses."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bracket_rest, bracket_tags
from ..operators.latest import latest_by_key
from .feeds import parse_feed

ITEM = "file string, seq int, url string, title string, comment string, tags array<string>, created string, private boolean"
_KEYS = [c.split()[0] for c in ITEM.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_()]


class _Netscape(HTMLParser):
    """The A and DD elements of a bookmark file."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.into: str | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.rows.append({
                "url": a["href"].strip(), "title": "", "comment": "", "tags": [t.strip() for t in (a.get("tags") or "").split(",") if t.strip()],
                "created": (a.get("add_date") or "").strip(), "private": (a.get("private") or "0").strip() in ("1", "true"),
            })
            self.into = "title"
        elif tag == "dd" and self.rows:
            self.into = "comment"
        elif tag in ("dt", "dl", "h3", "p"):
            self.into = None

    def handle_endtag(self, tag):
        if tag in ("a", "dl"):
            self.into = None

    def handle_data(self, data):
        if self.into and self.rows:
            self.rows[-1][self.into] += data


def parse_export(text: str | None) -> list[dict]:
    """Items of an export, Atom or RSS if it is such XML, else a bookmark file; none of a null text."""
    if not text or not text.strip():
        return []
    rows = parse_feed(text.strip(), "") if text.lstrip().startswith("<?xml") or "<feed" in text[:500] or "<rdf" in text[:500].lower() else []
    if rows:
        out = [{"url": r["url"], "title": r["title"], "comment": r["excerpt"], "tags": r["tags"], "created": r["published"], "private": None} for r in rows]
    else:
        p = _Netscape()
        p.feed(text)
        p.close()
        out = [{**r, "title": " ".join(r["title"].split()), "comment": " ".join(r["comment"].split())} for r in p.rows]
    return [{"seq": i, **r} for i, r in enumerate(out)]


def exported_items(files: DataFrame) -> DataFrame:
    """Rows of (file, body) as items; of one URL in a file the last stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"file": f, **r} for f, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in parse_export(body)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(_KEYS, _TYPES)], names=_KEYS)

    return latest_by_key(files.select("file", "body").mapInArrow(run, ITEM), ["file", "url"], [F.col("seq")])


SEARCH = "bookmarks array<struct<entry: struct<title: string, url: string, snippet: string>, timestamp: bigint, comment: string, is_private: string>>, meta struct<status: int, total: string>"


def search_problem(body: Column) -> Column:
    """What is wrong with an answer of a bookmark search; null for a sound one.

    Refused answers have their status in the body; sound ones a list and a whole number as total.
    """
    v = F.try_parse_json(body)
    status = F.try_variant_get(v, "$.meta.status", "string")
    total = F.try_variant_get(v, "$.meta.total", "string")
    listed = F.schema_of_variant(F.try_variant_get(v, "$.bookmarks", "variant")).startswith("ARRAY")
    return F.when(status.isin("401", "403"), F.concat(F.lit("refused with status "), status)).when(
        v.isNull() | ~F.coalesce(listed, F.lit(False)) | ~F.coalesce(total.rlike("^[0-9]+$"), F.lit(False)), F.lit("no valid answer")
    )


def search_items(responses: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of (query, seq, body) with JSON of a bookmark search as items.

    Rows without an entry or URL are dropped; of one URL over all responses the last wins, at the
    place (``first_seq``, ``first_pos``) where the URL came first.  An answer that is refused or not valid
    fails the job; if not ``strict``, it gives no rows, and :func:`search_problem` tells why.
    """
    problem = search_problem(F.col("body"))
    sound = F.coalesce(F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("bookmark search: "), problem)).cast("boolean")), F.lit(True)) if strict else problem.isNull()
    parsed = responses.where(sound).select("query", "seq", F.from_json("body", SEARCH).alias("r"))
    rows = parsed.select("query", "seq", F.posexplode("r.bookmarks").alias("pos", "b")).where(F.coalesce("b.entry.url", F.lit("")) != "")
    items = rows.select(
        "query", "seq", "pos", F.col("b.entry.url").alias("url"), F.col("b.entry.title").alias("title"), F.col("b.entry.snippet").alias("excerpt"),
        bracket_tags("b.comment").alias("tags"), bracket_rest("b.comment").alias("comment"), F.col("b.is_private").isin("1", "true").alias("private"),
        F.date_format(F.timestamp_seconds("b.timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created"),
    )
    firsts = items.groupBy("url").agg(F.min(F.struct("seq", "pos")).alias("f")).select("url", F.col("f.seq").alias("first_seq"), F.col("f.pos").alias("first_pos"))
    return latest_by_key(items, ["url"], [F.col("seq"), F.col("pos")]).join(firsts, "url")
