"""Scalar text functions: tags, file names, front matter, comments, tidying."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .urls import _c, url_host

#: Every character that counts as white space, for ``strip``-like trimming in the JVM.
WHITE = "\\s\\u000B\\u001C-\\u001F\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def strip(col: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(col), f"^[{WHITE}]+|[{WHITE}]+$", "")


def is_blank(col: Column | str) -> Column:
    """Whether a text is null, empty or white space only."""
    return F.coalesce(strip(col), F.lit("")) == ""


def collapse(col: Column | str) -> Column:
    """On one line, with single spaces."""
    return F.trim(F.regexp_replace(_c(col), f"[{WHITE}]+", " "))


def normalize_blocks(col: Column | str) -> Column:
    """Single spaces inside lines, at most one blank line between them, none at the ends."""
    s = F.regexp_replace(_c(col), "\r\n?", "\n")
    s = F.regexp_replace(s, "[ \\t\\u00A0\\u3000]+", " ")
    s = F.regexp_replace(s, " ?\n ?", "\n")
    return strip(F.regexp_replace(s, "\n{3,}", "\n\n"))


@arrow_udf(T.StringType())
def unescape_html(col: pa.Array) -> pa.Array:
    """Character references resolved."""
    return pa.array([None if v is None else html.unescape(v) if "&" in v else v for v in col.to_pylist()], pa.string())


@arrow_udf(T.StringType())
def nfc(col: pa.Array) -> pa.Array:
    """Canonical composition, for which there is no built-in function."""
    return pa.array([None if v is None else v if v.isascii() else unicodedata.normalize("NFC", v) for v in col.to_pylist()], pa.string())


def normalize_tag(col: Column | str) -> Column:
    """A tag for notes: lower case, hyphens for spaces, no leading ``#``; letters, digits, kana, ideographs, ``_-/`` only."""
    s = F.lower(F.regexp_replace(strip(col), "^#+", ""))
    s = F.regexp_replace(s, f"[{WHITE}]+", "-")
    s = F.regexp_replace(s, "[^\\p{L}\\p{N}_/\\-\\u3040-\\u30FF\\u3400-\\u9FFF]", "")
    return F.regexp_replace(s, "^[-/]+|[-/]+$", "")


def unique_tags(col: Column | str) -> Column:
    """Tags without repetition, whatever the case; first spellings stay, in order."""
    tags = F.filter(F.transform(F.coalesce(_c(col), F.array().cast("array<string>")), strip), lambda t: t.isNotNull() & (t != ""))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("seen"))
    step = lambda acc, t: F.when(F.array_contains(acc["seen"], F.lower(t)), acc).otherwise(
        F.struct(F.concat(acc["kept"], F.array(t)).alias("kept"), F.concat(acc["seen"], F.array(F.lower(t))).alias("seen"))
    )
    return F.aggregate(tags, start, step, lambda acc: acc["kept"])


def merge_tags(*cols: Column | str) -> Column:
    """Normalised tags of several lists, in order of first appearance, empty ones dropped."""
    all_tags = F.flatten(F.array(*[F.coalesce(_c(c), F.array().cast("array<string>")) for c in cols]))
    return F.array_distinct(F.filter(F.transform(F.filter(all_tags, lambda t: t.isNotNull()), normalize_tag), lambda t: t != ""))


def bracket_tags(col: Column | str) -> Column:
    """The leading ``[a][b]`` of a comment as tags."""
    head = F.regexp_extract(F.coalesce(_c(col), F.lit("")), r"^\s*((?:\[[^\[\]]+\]\s*)*)", 1)
    return F.transform(F.regexp_extract_all(head, F.lit(r"\[([^\[\]]+)\]"), 1), strip)


def bracket_rest(col: Column | str) -> Column:
    """A comment without its leading tags."""
    return strip(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"^\s*(?:\[[^\[\]]+\]\s*)*", ""))


# Fixed value: names of devices, which no file may have.
DEVICES = "^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"


def file_name(col: Column | str) -> Column:
    """A portable file name: letters, marks, digits, `` -_.`` only, single spaces, no device names.

    Empty for what has none of these.
    """
    s = F.regexp_replace(nfc(F.coalesce(_c(col), F.lit(""))), "[^\\p{L}\\p{M}\\p{N} \\-_.]", " ")
    s = F.regexp_replace(F.regexp_replace(s, " +", " "), "^[ .]+|[ .]+$", "")
    return F.when(F.upper(s).rlike(DEVICES), F.concat(s, F.lit("_"))).otherwise(s)


def note_name(title: Column | str, ident: Column | str, link: Column | None = None, length: int = 60) -> Column:
    """File name of a note: the start of its title, or else of its link, then its id."""
    shown = F.coalesce(F.nullif(_c(title), F.lit("")), F.nullif(link, F.lit("")) if link is not None else F.lit(None).cast("string"), F.lit("Untitled"))
    base = F.regexp_replace(F.substring(F.coalesce(F.nullif(file_name(shown), F.lit("")), F.lit("Untitled")), 1, length), "[ .]+$", "")
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit("Untitled")), F.lit(" - "), _c(ident), F.lit(".md"))


def feed_folder_path(layout: str, route: Column, folder: Column, month: Column) -> Column:
    """Where a feed's note goes below its provider: by route, feed, year and month, as the layout says.

    ``month`` is ``YYYY/MM`` or null for undated entries.
    """
    if layout == "flat":
        return F.lit("")
    parts = [F.nullif(safe_relative_path(route), F.lit(""))] if layout.startswith("route/") else []
    parts.append(F.coalesce(F.nullif(safe_relative_path(folder), F.lit("")), F.lit("RSS Feed")))
    if "year" in layout:
        parts.append(F.coalesce(month if "month" in layout else F.substring(month, 1, 4), F.lit("_undated")))
    return F.concat_ws("/", *parts)


def safe_relative_path(col: Column | str) -> Column:
    """A path from metadata that stays below its root."""
    parts = F.split(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"\\", "/"), "/")
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: ~p.isin("", ".", "..")), "/")


def yaml_scalar(col: Column | str) -> Column:
    """A quoted YAML scalar."""
    s = F.replace(F.replace(_c(col), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(s, F.lit("\n"), F.lit("\\n")), F.lit('"'))


def front_matter(fields: dict[str, Column], lists: dict[str, Column] | None = None, plain: dict[str, Column] | None = None) -> Column:
    """YAML front matter of text, lists of text, and plain numbers or booleans.

    Null and empty text is left out, and so are nulls of the other kinds; an empty list is ``[]``.
    """
    lines = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{k}: "), yaml_scalar(c))) for k, c in fields.items()]
    for k, c in (lists or {}).items():
        items = F.array_join(F.transform(c, lambda v: F.concat(F.lit("\n  - "), yaml_scalar(v))), "")
        lines.append(F.when(c.isNotNull(), F.when(F.size(c) > 0, F.concat(F.lit(f"{k}:"), items)).otherwise(F.lit(f"{k}: []"))))
    lines += [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in (plain or {}).items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def heading(col: Column | str) -> Column:
    return F.trim(F.replace(_c(col), F.lit("\n"), F.lit(" ")))


def without_ads(col: Column | str) -> Column:
    """Without lines that say nothing but "Advertisement"."""
    return F.regexp_replace(_c(col), r"(?im)^[ \t]*Advertisement[ \t]*$", "")


def clean_excerpt(url: Column | str, excerpt: Column | str, host: str, pattern: str) -> Column:
    """An excerpt on one line, without what one host puts into all of its own."""
    e = F.coalesce(_c(excerpt), F.lit(""))
    return collapse(F.when(url_host(url) == host, F.regexp_replace(e, pattern, " ")).otherwise(e))


def put_block(note: Column | str, block: Column | str, begin: str, end: str) -> Column:
    """A note with a managed block: in place of the first one it has, else at its end."""
    new = F.concat(F.lit(begin + "\n"), strip(block), F.lit("\n" + end))
    body = F.coalesce(_c(note), F.lit(""))
    i = F.locate(begin, body)
    rest = F.substr(body, i)
    j = F.locate(end, rest)
    replaced = F.concat(F.substr(body, F.lit(1), i - 1), new, F.substr(rest, j + len(end)))
    appended = F.concat_ws("\n\n", F.nullif(F.regexp_replace(body, f"[{WHITE}]+$", ""), F.lit("")), new)
    return strip(F.when((i > 0) & (j > 0), replaced).otherwise(appended))


def clip(col: Column | str, length: int, marker: str = "") -> Column:
    """At most so many characters, with a marker at the end of what was cut."""
    s = _c(col)
    return F.when(F.length(s) > length, F.concat(F.substring(s, 1, length - len(marker)), F.lit(marker))).otherwise(s)


def untrusted(prompt: Column | str, begin: str, end: str, most: int, marker: str = "\n[truncated]") -> Column:
    """A text between marks that say whose it is, cut so that all of it has at most so many characters."""
    return F.concat(F.lit(begin), clip(prompt, max(len(marker), most - len(begin) - len(end)), marker), F.lit(end))


def first_route(tags: Column | str, routes: Column | str) -> Column:
    """The route of the first tag that has one, whatever the case; empty if none has. ``routes`` is a map."""
    low = F.transform_keys(_c(routes), lambda k, v: F.lower(k))
    hits = F.filter(F.transform(F.coalesce(_c(tags), F.array().cast("array<string>")), lambda t: F.try_element_at(low, F.lower(t))), lambda r: r.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(""))


def fallback_summary(title: Column, link: Column, excerpt: Column, note: Column, body: Column, tags: Column, item_type: Column) -> Column:
    """A summary without a model: the excerpt, else the note, else the first paragraph, and up to eight tags."""
    some = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    first = F.substring(F.regexp_extract(F.coalesce(some(body), some(excerpt), F.lit("")), r"(?m)^[^\S\n]*(\S.*?)[^\S\n]*$", 1), 1, 500)
    raw = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        F.coalesce(raw(title), raw(link), F.lit("Untitled bookmark")).alias("note_title"), F.coalesce(some(excerpt), some(note), raw(first), F.lit("Summary unavailable.")).alias("summary"),
        F.array().cast("array<string>").alias("key_points"), F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 8).alias("tags"), F.coalesce(raw(item_type), F.lit("link")).alias("content_type"),
    )


def time_ordered_id(at: Column, *parts: Column) -> Column:
    """An id in the form of a UUID that sorts by time and is the same in a second run: milliseconds, version 7, a hash of the parts."""
    h = F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    ms = F.lpad(F.lower(F.hex(F.unix_millis(at.cast("timestamp")))), 12, "0")
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(h, 1, 3), F.lit("-8"), F.substring(h, 4, 3), F.lit("-"), F.substring(h, 7, 12))


def plain_of_html(col: Column | str) -> Column:
    """Plain text of a fragment of HTML: no tags, references resolved, one line."""
    s = F.regexp_replace(_c(col), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return collapse(unescape_html(F.regexp_replace(s, r"(?s)<[^>]*>", " ")))
