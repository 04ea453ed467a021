"""HTML pages: title, text of the article, links, images, exports of bookmarks."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Elements, roles and names by which parts of a page are told apart.
SKIPPED = frozenset("aside canvas dialog footer form header nav noscript script style svg template".split())
SKIPPED_ROLES = frozenset("banner complementary contentinfo navigation".split())
SKIPPED_NAMES = frozenset("ad ads advert advertisement banner comment comments consent cookie footer header nav navigation promo recommend related reply share sidebar social sponsored".split())
CONTENT_NAMES = frozenset("article content entry main post story".split())
BLOCKS = frozenset("article blockquote br dd div dt figcaption h1 h2 h3 h4 h5 h6 li main p pre section td th tr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_CONTENT_IMAGE = re.compile(r"(?:^|[-_\s])(?:ad|ads|advert|advertisement|banner|promo|sponsor|tracking|pixel)(?:$|[-_\s])")


def _tokens(attrs: dict) -> set[str]:
    return set(re.findall("[a-z0-9]+", " ".join(attrs.get(k) or "" for k in ("class", "id", "role")).lower()))


class _Region:
    """An open element whose text may be that of the page."""

    def __init__(self, rank: int, depth: int) -> None:
        self.rank, self.depth, self.parts, self.images = rank, depth, [], []


class PageParser(HTMLParser):
    """Title, candidate regions and images of a page, in one pass.

    Regions rank by element or by what their class says: article, main, then content-like
    names; the longest of the highest rank is the text, and all text if there is none.
    """

    def __init__(self, base: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.depth, self.hidden_at, self.in_title = base, 0, 0, False
        self.title_parts: list[str] = []
        self.everything = _Region(0, 0)
        self.open: list[_Region] = [self.everything]
        self.closed: list[_Region] = []
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v for k, v in attrs}
        if tag in BLOCKS and not self.hidden_at:
            self._text("\n")
        if tag == "title" and not self.title_parts:
            self.in_title = True
        if not self.hidden_at:
            if tag == "a" and a.get("href"):
                self.links.append(urljoin(self.base, a["href"].strip()))
            if tag == "img":
                self._image(a)
        if tag in VOID:
            return
        self.depth += 1
        if self.hidden_at:
            return
        marks = _tokens(a)
        if tag in SKIPPED or (a.get("role") or "").lower() in SKIPPED_ROLES or marks & SKIPPED_NAMES:
            self.hidden_at = self.depth
            return
        rank = 3 if tag == "article" else 2 if tag == "main" else 1 if marks & CONTENT_NAMES else 0
        if rank:
            self.open.append(_Region(rank, self.depth))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in VOID or not self.depth:
            return
        if tag in BLOCKS and not self.hidden_at:
            self._text("\n")
        if len(self.open) > 1 and self.open[-1].depth == self.depth:
            self.closed.append(self.open.pop())
        if self.hidden_at == self.depth:
            self.hidden_at = 0
        self.depth -= 1

    def handle_data(self, data):
        if self.in_title:
            self.title_parts.append(data)
        elif not self.hidden_at and data.strip():
            self._text(data.strip())

    def _text(self, data: str) -> None:
        for r in self.open:
            r.parts.append(data)

    def _image(self, a: dict) -> None:
        sets = [p.strip().split()[0] for p in (a.get("srcset") or a.get("data-srcset") or "").split(",") if p.strip()]
        src = next((a[k] for k in ("data-src", "data-original", "data-lazy-src", "src") if a.get(k) and not a[k].startswith("data:")), sets[-1] if sets else None)
        if not src:
            return
        url = urljoin(self.base, src.strip())
        small = all((a.get(k) or "").isdigit() and 0 < int(a[k]) <= 10 for k in ("width", "height"))
        if small or NO_CONTENT_IMAGE.search(" ".join(a.get(k) or "" for k in ("class", "id", "role", "aria-label")).lower()):
            return
        for r in self.open:
            r.images.append((url, (a.get("alt") or "").strip()))

    def region(self) -> _Region:
        found = [r for r in self.closed + self.open[1:] if " ".join(r.parts).strip()]
        if not found:
            return self.everything
        rank = max(r.rank for r in found)
        return max((r for r in found if r.rank == rank), key=lambda r: len(tidy(" ".join(r.parts))))


def tidy(text: str) -> str:
    """Single spaces in lines, at most one blank line between them."""
    lines = [" ".join(x.split()) for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def parse_page(text: str | None, base: str = "") -> dict:
    """Title, text, links and images of a page; empty ones for a null or empty text."""
    p = PageParser(base or "")
    p.feed(text or "")
    p.close()
    r = p.region()
    return {
        "title": " ".join("".join(p.title_parts).split()),
        "text": re.sub(r"\n{2,}", "\n", tidy(" ".join(r.parts))),
        "links": list(dict.fromkeys(p.links)),
        "images": [{"url": u, "alt": a} for u, a in dict(reversed(r.images)).items()][::-1] if r.images else [],
    }


_IMAGE = T.StructType().add("url", T.StringType()).add("alt", T.StringType())
_PARTS = T.StructType().add("title", T.StringType()).add("text", T.StringType()).add("links", T.ArrayType(T.StringType())).add("images", T.ArrayType(_IMAGE))


@arrow_udf(_PARTS)
def page_parts(text: pa.Array, base: pa.Array) -> pa.Array:
    """:func:`parse_page` of columns."""
    got = [parse_page(t, b) for t, b in zip(text.to_pylist(), base.to_pylist())]
    image = pa.list_(pa.struct([("url", pa.string()), ("alt", pa.string())]))
    return pa.array(got, pa.struct([("title", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string())), ("images", image)]))


_META = re.compile(rb"""<meta[^>]+charset=["']?\s*([A-Za-z0-9_\-]+)""", re.I)


def decode_page(raw: bytes | None, charset: str | None) -> str | None:
    """Text of a page's bytes: by the header's charset, a byte order mark, the page's own word, UTF-8, else Latin-1."""
    if raw is None:
        return None
    told = [charset] if charset else []
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    m = _META.search(raw[:2048])
    if m:
        told.append(m[1].decode())
    for name in [*told, "utf-8"]:
        try:
            return raw.decode(name.strip().strip("\"'"))
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("latin-1")


@arrow_udf(T.StringType())
def page_text(raw: pa.Array, charset: pa.Array) -> pa.Array:
    """:func:`decode_page` of columns."""
    return pa.array([decode_page(r, c) for r, c in zip(raw.to_pylist(), charset.to_pylist())], pa.string())
