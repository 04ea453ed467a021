"""Feeds: RSS 2.0, RSS 1.0 and Atom, whatever their namespaces, as rows."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_route, unique_tags
from ..functions.urls import content_key, default_feed_folder, feed_source_id

ENTRY = "feed_url string, seq int, native_id string, url string, title string, excerpt string, content string, tags array<string>, published string, updated string"
_KEYS = [c.split()[0] for c in ENTRY.split(", ")]


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def _first(e: ET.Element, *names: str) -> str:
    for n in names:
        for c in e:
            if _name(c) == n:
                t = "".join(c.itertext()).strip()
                if t:
                    return t
    return ""


def _absolute(base: str, href: str) -> str:
    """A link as it stands if it is absolute, else resolved against the feed."""
    return href if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", href) else urljoin(base, href)


def _plain(text: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", html.unescape(text))).split())


def _link(e: ET.Element, base: str) -> str:
    links = [c for c in e if _name(c) == "link"]
    typed = [(c.get("rel", "alternate"), c.get("type", ""), c.get("href", "")) for c in links if c.get("href")]
    for want in (lambda r, t: r == "alternate" and t in ("text/html", "application/xhtml+xml"), lambda r, t: r == "alternate", lambda r, t: True):
        for rel, kind, href in typed:
            if want(rel, kind):
                return _absolute(base, href.strip())
    text = next(("".join(c.itertext()).strip() for c in links if "".join(c.itertext()).strip()), "")
    if text:
        return _absolute(base, text)
    guid = next((c for c in e if _name(c) == "guid" and c.get("isPermaLink", "true").lower() != "false"), None)
    ident = (guid.text or "").strip() if guid is not None else ""
    about = next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "about"), "")
    for v in (ident, about):
        if v.startswith(("http://", "https://")):
            return v
    return ""


def parse_feed(xml: str | bytes | None, feed_url: str) -> list[dict]:
    """Entries of a feed in its order.

    What is no XML, and a null or empty text, has none; entries without link, id and title are
    left out.
    """
    if not xml:
        return []
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, ValueError):
        return []
    out = []
    for e in (x for x in root.iter() if _name(x) in ("item", "entry")):
        url = _link(e, feed_url)
        title = _plain(_first(e, "title"))
        native = _first(e, "guid", "id") or url
        if not (native or title):
            continue
        tags: list[str] = []
        for c in e:
            if _name(c) in ("category", "subject"):
                t = (c.get("label") or c.get("term") or "".join(c.itertext())).strip()
                if t and t.casefold() not in {x.casefold() for x in tags}:
                    tags.append(t)
        content = _first(e, "encoded", "content")
        out.append({
            "feed_url": feed_url, "seq": len(out), "native_id": native, "url": url, "title": title,
            "excerpt": _plain(_first(e, "description", "summary") or content), "content": _plain(content), "tags": tags,
            "published": _first(e, "pubdate", "published", "issued", "date"), "updated": _first(e, "updated", "modified"),
        })
    return out


def feed_title(xml: str | bytes | None) -> str | None:
    """A feed's own title, empty if it has none; null for what is no feed that can be read."""
    try:
        root = ET.fromstring(xml or "")
    except (ET.ParseError, ValueError):
        return None
    channel = root if _name(root) == "feed" else next((x for x in root.iter() if _name(x) == "channel"), root)
    return _plain(_first(channel, "title"))


def read_feeds(feeds: DataFrame) -> DataFrame:
    """feed_url, ``readable`` and the title of each feed (feed_url, body): a feed that can't be read is named, not passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [feed_title(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g is not None for g in got]), pa.array(got, pa.string())], names=["feed_url", "readable", "feed_title"])

    return feeds.select("feed_url", "body").mapInArrow(run, "feed_url string, readable boolean, feed_title string")


def feed_items(feeds: DataFrame) -> DataFrame:
    """Entries of configured feeds (feed_url, body, name, folder, tags, route, routes) as items of an archive.

    The feed's tags come first, the name and folder stand in for its title, and a feed without a route
    takes that of the first tag of an entry that has one.  The id is made of the feed's URL and the entry's own id.
    """
    own = feeds.select("feed_url", "name", "folder", F.coalesce("tags", F.array().cast("array<string>")).alias("feed_tags"), "route", "routes").join(read_feeds(feeds).where("readable"), "feed_url")
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    own = own.withColumn("title_", F.coalesce(some("name"), some("feed_title"), F.lit(""))).withColumn("folder_", F.coalesce(some("folder"), some("title_"), default_feed_folder("feed_url")))
    e = entries(feeds).where(F.col("url").rlike("^https?://")).join(own.select("feed_url", "feed_tags", "route", "routes", "title_", "folder_"), "feed_url")
    meta = F.create_map(
        F.lit("feed_url"), F.col("feed_url"), F.lit("feed_title"), F.col("title_"), F.lit("feed_folder"), F.col("folder_"), F.lit("feed_route"), F.coalesce(some("route"), first_route("tags", "routes"), F.lit("")),
        F.lit("entry_id"), F.col("native_id"), F.lit("published_at"), F.coalesce("published", F.lit("")),
    )
    return e.select(
        F.lit("rss").alias("source"), feed_source_id("feed_url", "native_id").alias("source_id"), content_key("url").alias("content_key"), "url", "title", "excerpt", unique_tags(F.concat("feed_tags", "tags")).alias("tags"),
        F.coalesce(some("published"), some("updated"), F.lit("")).alias("created_at"), F.col("updated").alias("updated_at"), meta.alias("provider_metadata"), F.col("content").alias("embedded_content"),
    )


def entries(feeds: DataFrame) -> DataFrame:
    """Rows of (feed_url, body) as entries; a feed that can't be read gives none, and :func:`read_feeds` names it."""
    types = [pa.string(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [e for url, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for e in parse_feed(body, url or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(_KEYS, types)], names=_KEYS)

    return feeds.select("feed_url", "body").mapInArrow(run, ENTRY)
