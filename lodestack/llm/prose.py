"""Text quality counts of a piece of a document, their merge, and the ratios drawn from them.

A state is a monoid: :func:`count` makes it of any piece of a text, :func:`merge` joins the
states of neighbouring pieces, and whatever the cuts, the merged state is that of the whole
text.  A line cut in two stays open on that side; a word cut in two is kept as a fragment
until its other part arrives.  Nothing here needs Spark.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_K, _H, _T = "一-鿿々〆ヶ", "ぁ-ゖ", "ァ-ヵヷ-ヿ"
_TOKEN = re.compile(f"[{_K}]+|[{_H}]+|[{_T}]+|[^\\W_{_K}{_H}{_T}]+")
_CJK_CHAR = re.compile(f"[{_K}{_H}{_T}]")
_HIRAGANA = re.compile(f"[{_H}]")
_DIGIT = re.compile(r"\d")
_STOP = re.compile(r"[.!?…](?=[\s”»\"'’“)\]]|$)|[。！？]")
_BULLET = re.compile(r"^(?:[-*+•・>#»–]|\d{1,3}[.)]|\[[ x]\])+\s*")
_SPEAKER = re.compile(r"^[^\s:：]{1,30}[:：]\s*")
_TOLD_END = re.compile(f"[{_H}ー〜~](?:[笑w]|lol|（笑）|\\(笑\\)|[^\\w#])*$")
_CLOSERS = "”»“\"'’」』)）]*_"
_CODE = re.compile(r"\$ |export |SELECT |git |curl |printf|print\(|def |return |import |for \w+ in |if \(|assert |\w+ = ")
_CALL = re.compile(r"\w\(")
_URL = re.compile(r"https?://\S")
_WHITE = re.compile(r"\s")
#: Length of the longest word kept as text; longer fragments keep only their length.
_KEEP = 48
#: A line of more words than this without any stop is no sentence.
_LONG = 60
#: Parts of a line's text kept at its ends, for bullets, speakers and closing marks.
_EDGE = 40

# The articles among the common words, which keyword strings also hold.
ARTICLES = frozenset("the a an der die das le la les l un une o os as um uma des du".split())


def _kind(ch: str) -> str:
    if _CJK_CHAR.match(ch):
        return "H" if _HIRAGANA.match(ch) else "K" if not "ァ" <= ch <= "ヿ" else "T"
    return "W"


class Line(NamedTuple):
    """Counts of one line, or of a part of it with open ends."""

    size: int = 0  # characters
    solid: int = 0  # characters that are not white space
    words: int = 0
    word_chars: int = 0
    common: int = 0
    plain_common: int = 0  # common words that are no articles
    digits: int = 0
    hiragana: int = 0
    cjk: int = 0
    stops: int = 0  # sentence ends inside, the very end aside
    seen: frozenset = frozenset()  # hashes of its words, up to _LONG
    front: tuple = ()  # word fragment at an open start: (kind, text, length), and whether it is the whole part
    back: tuple = ()
    indent: str = ""  # white space at its start, what follows, and the same at its end
    head: str = ""
    tail: str = ""
    trail: str = ""
    ended: bool | None = False  # whether it ends in a stop; None if nothing but closing marks are seen
    white: bool = False  # white space anywhere, and before its last solid character
    gap: bool = False
    call: bool = False  # a word before an opening parenthesis
    shell: bool = False  # "=$"
    url: bool = False  # an address in its last solid run
    bars: int = 0
    first_bar: bool = False  # a bar before any white space


class Doc(NamedTuple):
    """Sums over closed lines, and the open ones at both ends."""

    lines: int = 0  # line breaks seen
    filled: int = 0  # closed lines that are not blank
    punctuated: int = 0
    solid: int = 0
    words: int = 0
    word_chars: int = 0
    common: int = 0
    told: int = 0  # characters of lines that are sentences with their stops
    open_told: int = 0  # characters of lines that read like sentences without stops
    first: Line = Line()
    last: Line = Line()


def _word(line: dict, token: str, length: int, common: frozenset) -> None:
    line["words"] += 1
    line["word_chars"] += length
    low = token.lower()
    if length < _KEEP and low in common:
        line["common"] += 1
        if low not in ARTICLES:
            line["plain_common"] += 1
    if len(line["seen"]) <= _LONG:
        line["seen"] = line["seen"] | {hash_of(low)}


def hash_of(word: str) -> int:
    """A hash that is the same in every process."""
    h = 0xCBF29CE484222325
    for b in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def _marks(text: str) -> dict:
    """The fields of a part that tell how it begins and ends, and signs of code."""
    left = text.lstrip()
    solid = text.rstrip()
    bare = solid.rstrip(_CLOSERS)
    words = text.split()
    return {
        "indent": text[: len(text) - len(left)][:_EDGE], "head": left[:_EDGE], "tail": solid[-_EDGE:], "trail": text[len(solid) :][-_EDGE:],
        "ended": bare[-1] in ".!?。！？…" if bare else None if solid else False, "white": len(words) != 1 or len(words[0]) != len(text), "gap": len(words) > 1 or bool(words) and left != text,
        "call": "(" in text and bool(_CALL.search(text)), "shell": "=$" in text, "url": bool(words) and "://" in words[-1] and bool(_URL.search(words[-1])),
        "bars": text.count("|"), "first_bar": "|" in text and "|" in _WHITE.split(text, maxsplit=1)[0],
    }


def _join_marks(a: Line, b: Line) -> dict:
    apart = bool(a.trail) or not a.head  # white space, or nothing, before b
    if not b.head:
        end = {"tail": a.tail, "trail": (a.trail + b.trail)[-_EDGE:] if a.head else b.trail, "ended": a.ended, "gap": a.gap, "url": a.url}
        if not a.head:
            end["trail"] = (a.trail + b.trail)[-_EDGE:]
    else:
        ended = b.ended
        if ended is None:
            ended = a.ended if not apart else False
        one = not b.gap and not apart and not b.indent
        url = b.url or one and (a.url or bool(_URL.search(a.tail[-8:] + b.head[:9])))
        end = {"tail": (a.tail + a.trail + b.indent + b.tail)[-_EDGE:] if len(b.tail) < _EDGE else b.tail, "trail": b.trail, "ended": ended, "gap": a.white or b.gap, "url": url}
    touch = not apart and not b.indent and bool(b.head)
    return end | {
        "indent": a.indent if a.head else (a.indent + b.indent)[:_EDGE], "head": (a.head + (a.trail if len(a.head) < _EDGE else "") + b.indent + b.head)[:_EDGE] if a.head and b.head else a.head or b.head,
        "white": a.white or b.white, "call": a.call or b.call or touch and b.head[0] == "(" and bool(_CALL.match(a.tail[-1] + "(")), "shell": a.shell or b.shell or touch and a.tail[-1] == "=" and b.head[0] == "$",
        "bars": a.bars + b.bars, "first_bar": a.first_bar or not a.white and b.first_bar,
    }


def _code(line: Line) -> bool:
    """Whether a line looks like source code, by its start, its end and what it holds."""
    last = line.tail[-1:]
    return bool(_CODE.match(line.head)) or last in (";", "{", "}") or line.call and last == ")" or line.shell or line.url or line.first_bar and line.bars > 1


def _stops(text: str) -> int:
    """Stops inside a part; one at its very end counts by what follows it."""
    return len(_STOP.findall((text[:-1] if text[-1:] in ".!?…。！？" else text) + "x"))


def _part(text: str, common: frozenset) -> Line:
    """State of a part of a line whose ends are both open."""
    tokens = list(_TOKEN.finditer(text))
    front = back = ()
    lo, hi = 0, len(tokens)

    def piece(m):
        t = m.group()
        return (_kind(t[0]), t if len(t) < _KEEP else "", len(t), len(t) == len(text))

    if tokens and tokens[0].start() == 0:
        front, lo = piece(tokens[0]), 1
    if hi > lo and tokens[-1].end() == len(text):
        back, hi = piece(tokens[-1]), hi - 1
    elif front and front[3]:
        back = front
    acc = {"words": 0, "word_chars": 0, "common": 0, "plain_common": 0, "seen": frozenset()}
    for m in tokens[lo:hi]:
        _word(acc, m.group(), m.end() - m.start(), common)
    return Line(
        size=len(text), solid=len("".join(text.split())), digits=len(_DIGIT.findall(text)), hiragana=len(_HIRAGANA.findall(text)),
        cjk=len(_CJK_CHAR.findall(text)), stops=_stops(text), front=front, back=back,
        **_marks(text), **acc,
    )


def _join(a: Line, b: Line, common: frozenset) -> Line:
    """Two neighbouring parts of one line as one part."""
    if not a.size:
        return b
    if not b.size:
        return a
    acc = {
        "words": a.words + b.words, "word_chars": a.word_chars + b.word_chars, "common": a.common + b.common,
        "plain_common": a.plain_common + b.plain_common, "seen": frozenset(list(a.seen | b.seen)[: _LONG + 1]),
    }
    front, back = a.front, b.back
    if a.back and b.front and a.back[0] == b.front[0]:  # one word cut in two
        n = a.back[2] + b.front[2]
        text = a.back[1] + b.front[1] if n < _KEEP else ""
        whole_a, whole_b = a.back[3], b.front[3]
        word = (a.back[0], text, n, whole_a and whole_b)
        if whole_a and whole_b:
            front = back = word
        elif whole_a:
            front = word
        elif whole_b:
            back = word
        else:
            _word(acc, text, n, common)
    else:
        if a.back:
            if a.back[3]:
                front = (*a.back[:3], False)
            else:
                _word(acc, a.back[1], a.back[2], common)
        if b.front:
            if b.front[3]:
                back = (*b.front[:3], False)
            else:
                _word(acc, b.front[1], b.front[2], common)
    # a stop at the seam is one only by what follows it
    seam, before = 0, a.tail[-1:] if not a.trail else ""
    follow = (b.indent or b.head)[:1]
    if before and before in ".!?…。！？":
        seam = len(_STOP.findall(before + follow))
        if b.size == 1 and seam and follow in ".!?…。！？":
            seam = len(_STOP.findall(before + "x"))
    return Line(
        size=a.size + b.size, solid=a.solid + b.solid, digits=a.digits + b.digits, hiragana=a.hiragana + b.hiragana, cjk=a.cjk + b.cjk,
        stops=a.stops + b.stops + min(seam, 1), front=front, back=back, **_join_marks(a, b), **acc,
    )


def _closed(line: Line, common: frozenset) -> Line:
    acc = {"words": line.words, "word_chars": line.word_chars, "common": line.common, "plain_common": line.plain_common, "seen": line.seen}
    if line.front:
        _word(acc, line.front[1], line.front[2], common)
    if line.back and not line.back[3]:
        _word(acc, line.back[1], line.back[2], common)
    elif line.back and not line.front:
        _word(acc, line.back[1], line.back[2], common)
    return line._replace(front=(), back=(), **acc)


def _judge(line: Line) -> str:
    """``told`` for sentences with stops, ``open`` for what reads like one without, or ''."""
    words, common, plain, word_chars, solid, digits = line.words, line.common, line.plain_common, line.word_chars, line.solid, line.digits
    hira, cjk, stops, seen, ended = line.hiragana, line.cjk, line.stops, line.seen, bool(line.ended)
    body = _BULLET.sub("", line.head)
    letters = word_chars - digits
    if not words or letters < 0.55 * solid or digits > (0.45 if ended and stops else 0.3) * word_chars:
        return ""
    if cjk > 0.3 * letters:
        flowing = hira >= 0.15 * cjk and common >= 2 and cjk >= 8
        if flowing and (ended or stops and stops * 120 > cjk):
            return "told"
        # headlines end in a noun, keyword strings have signs before their words
        remark = bool(_TOLD_END.search(line.tail)) and not line.head.startswith("#")
        return "open" if flowing and remark and plain >= 2 and hira >= 0.3 * cjk and cjk >= 16 else ""
    if not ended and _code(line):
        return ""
    if words < 4:
        return ""
    if (ended or stops * 60 > words) and (common >= 1 and common >= 0.1 * words or ended and letters >= 0.75 * solid and digits < 0.1 * letters):
        return "told"
    said = _SPEAKER.sub("", body)
    if said[:1].islower() and words >= 6 and words <= _LONG and common >= 2 and plain >= 1 and common >= 0.12 * words and len(seen) >= 0.7 * words:
        return "open"
    return ""


def _add(doc: dict, line: Line) -> None:
    """Adds a closed line to the sums."""
    if not line.solid:
        return
    doc["filled"] += 1
    doc["solid"] += line.solid
    doc["words"] += line.words
    doc["word_chars"] += line.word_chars
    doc["common"] += line.common
    doc["punctuated"] += bool(line.ended)
    kind = _judge(line)
    if kind == "told":
        doc["told"] += line.solid
    elif kind == "open":
        doc["open_told"] += line.solid


_SUMS = ("filled", "punctuated", "solid", "words", "word_chars", "common", "told", "open_told")
_EMPTY = dict.fromkeys(_SUMS, 0)


def _line(text: str, common: frozenset) -> Line:
    """State of a whole line; the fast way to ``_closed(_part(text))``."""
    tokens = _TOKEN.findall(text)
    n = len(tokens)
    hits = plain = 0
    for t in tokens:
        low = t.lower()
        if low in common:
            hits += 1
            plain += low not in ARTICLES
    return Line(
        size=len(text), solid=len("".join(text.split())), words=n, word_chars=sum(map(len, tokens)), common=hits, plain_common=plain,
        digits=len(_DIGIT.findall(text)), hiragana=len(_HIRAGANA.findall(text)), cjk=len(_CJK_CHAR.findall(text)), stops=_stops(text),
        seen=frozenset(t.lower() for t in tokens) if n <= _LONG else frozenset(range(_LONG + 1)), **_marks(text),
    )


def count(text: str, common: frozenset) -> Doc:
    """State of a piece of a document."""
    lines = text.split("\n")
    if len(lines) == 1:
        part = _part(lines[0], common)
        return Doc(first=part, last=part)
    sums = dict(_EMPTY)
    for line in lines[1:-1]:
        if line:
            _add(sums, _line(line, common))
    return Doc(lines=len(lines) - 1, first=_part(lines[0], common), last=_part(lines[-1], common), **sums)


def merge(a: Doc, b: Doc, common: frozenset) -> Doc:
    """State of two neighbouring pieces as one; associative."""
    sums = {k: getattr(a, k) + getattr(b, k) for k in _SUMS}
    if not a.lines and not b.lines:
        part = _join(a.first, b.first, common)
        return Doc(first=part, last=part)
    if not a.lines:
        return b._replace(first=_join(a.first, b.first, common))
    if not b.lines:
        return a._replace(last=_join(a.last, b.first, common))
    _add(sums, _closed(_join(a.last, b.first, common), common))
    return Doc(lines=a.lines + b.lines, first=a.first, last=b.last, **sums)


#: Share of characters in sentences from which a text is natural prose.
MIN_TOLD = 0.5


def finish(doc: Doc, common: frozenset) -> dict:
    """Ratios and rule outcomes of a whole document."""
    sums = {k: getattr(doc, k) for k in _SUMS}
    for line in (doc.first, doc.last) if doc.lines else (doc.first,):
        _add(sums, _closed(line, common))
    return _ratios(sums)


def _ratios(s: dict) -> dict:
    told = s["told"] + s["open_told"]
    share = told / s["solid"] if s["solid"] else None
    return {
        "word_count": s["words"],
        "mean_word_length": s["word_chars"] / s["words"] if s["words"] else None,
        "symbol_ratio": (s["solid"] - s["word_chars"]) / s["solid"] if s["solid"] else None,
        "punctuated_lines": s["punctuated"] / s["filled"] if s["filled"] else None,
        "common_words": s["common"] / s["words"] if s["words"] else None,
        "sentence_share": share,
        "natural_prose": None if share is None else share >= MIN_TOLD,
    }


def measure(text: str | None, common: frozenset) -> dict:
    """Ratios of a text in one go, the same as of its merged pieces."""
    sums = dict(_EMPTY)
    if text:
        for line in text.split("\n"):
            if line:
                _add(sums, _line(line, common))
    return _ratios(sums)
