"""Page furniture: the nodes of a site style tree over the lines of pages, and their removal.

Pages come as text, one line per block.  A page's tree has presentation nodes (heading, list
item, plain line, each as a link or not) and below them content nodes, the segments of the line
between separators and sentence ends, with digits masked; a heading or lead line is the parent of
the list below it.  The trees of one host are merged, and a node that stands in m of the host's n
pages with content of their own has importance 1 - log m / log n: the entropy of its spread over
the pages, from 1 for what one page has to 0 for what all have.  Lines made of nodes of low
importance go, and with a heading the branch below it.  Nodes that spread over many hosts, of the
same entropy, are an addition for hosts with few pages.  No phrase is known in advance.

Nothing here needs Spark.
"""

from __future__ import annotations

import re

import xxhash

from . import mojibake, residue

#: Longest line that is remembered, and longest node that is masked name by name; longer ones are nodes with digits masked only.
MAX_LINE, MAX_NODE = 240, 120

_STYLE = re.compile(r"\s*(#{1,6}\s|[-*•・+»›]\s|\d{1,3}[.)]\s|>\s)?\s*(.*)", re.S)
_BOLD = re.compile(r"^\*\*(.+)\*\*$|^__(.+)__$")
_LINK = re.compile(r"^\[([^\]]*)\]\(([^)\s]*)\)$")
_HOST = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
_SPLIT = re.compile(r"\s+[|·»›>/•]\s+|(?<=[.!?])\s+(?=\S)|(?<=。)\s*(?=\S)|\s*\t\s*")
# the same for lines without 。, from a blank on: a search skips all other places
_SPLIT_BLANKS = re.compile(r"\s(?:\s*[|·»›>/•]\s+|(?<=[.!?]\s)\s*(?=\S)|\s*\t\s*|(?<=\t)\s*)")
_BREAD = re.compile(r"\s+[|·»›>/•]\s+")
_DIGITS = re.compile(r"\d\d*")  # a search skips to the first digit
_NAME = re.compile(r"[A-ZÀ-Þ][A-Za-zÀ-ÿ’']*(?: [A-ZÀ-Þ][A-Za-zÀ-ÿ’']*){0,3}")
_PREFIX = re.compile(r"^([^:：]{2,30} ?[:：])\s+\S")
_CJK = re.compile("[ぁ-ヿ一-鿿]")
_QUOTED = re.compile("[“”«»„「」`]")


_STOPS = (".", "!", "?", "。", "！", "？")
_MARKS = ("- ", "* ", "• ", "・", "+ ")


def candidate(line: str) -> bool:
    """Whether a line can be furniture, by what costs next to nothing to see; quotations are not."""
    return bool(line) and not line.startswith("> ")


def _ends(body: str) -> bool:
    """Whether a line ends like a sentence, closing marks aside."""
    return body.rstrip("”»\"’」)").endswith(_STOPS)


def _running(line: str) -> bool:
    """Whether a line is a paragraph: as a node it counts whole, not sentence by sentence."""
    return line.count("。") > 2 or line.count(". ") > 2


#: Bits of a node's id that tell its presentation node; they are 0 for plain lines and where hosts are merged.
KIND_BITS = {"p": 0, "li": 2, "h": 4, "#": 6}
#: The bit of nodes that are links; they are learnt apart from plain text, by all hosts too.
LINK_BIT = 8


def node_id(text: str, kind: str = "p") -> int:
    """64-bit id of a content node, signed, the same in every process; odd for a sentence."""
    return (xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)) & ~15 | KIND_BITS.get(kind, 0) | text.endswith(_STOPS)


def _enough(rest: str) -> bool:
    rest = rest.strip(" .,:0")
    return len(rest) >= 5 or "©" in rest or len(_CJK.findall(rest)) >= 2


def masked(seg: str) -> list[str]:
    """The further forms under which a segment with digits masked counts: with each name masked."""
    out: list[str] = []
    if len(seg) > MAX_NODE:
        return out
    for m in _NAME.finditer(seg):
        rest = seg[: m.start()] + seg[m.end() :]
        if _enough(rest):
            out.append(seg[: m.start()] + "¤" + seg[m.end() :])
        first = m.group().find(" ") + 1
        if first and m.start() == 0:  # the first word may be capital for its place only
            out.append(seg[:first] + "¤" + seg[m.end() :])
    m = _PREFIX.match(seg) if ":" in seg or "：" in seg else None
    if m:
        out.append(m.group(1) + " ¤¤")
    return out


#: What garbled text holds, of the cheapest kind to look for.
_MAYBE_GARBLED = re.compile(f"[\x80-\xa9\xac-\xb6\xb8-\xba\xbc-\xbfÂ-ÅÈÊ-ÞâãðñŒŠŽžƒˆ‰†‡‹›€™Ѐ-ӿͰ-Ͽ─-◿｡-ﾟ√∂≈∞Ω&⌐ⁿ{mojibake._ideographs({0, 2})}]")


def quick(line: str) -> str:
    """A line with the usual wrong decodings undone."""
    return line if line.isascii() or _MAYBE_GARBLED.search(line) is None else mojibake.quick(line)


def parse(line: str) -> tuple[str, str, str]:
    """Presentation, body and link target of a line."""
    m = _STYLE.match(line)
    mark, body = (m.group(1) or "").strip(), m.group(2).strip()
    kind = "#" if mark in ("#", "##") else "h" if mark[:1] == "#" else ">" if mark == ">" else "li" if mark else "p"
    bold = _BOLD.match(body) if body.startswith(("**", "__")) else None
    if bold:
        body, kind = (bold.group(1) or bold.group(2)).strip(), "h" if kind == "p" else kind
    link = _LINK.match(body) if body.startswith("[") else None
    return (kind, link.group(1).strip(), link.group(2)) if link else (kind, body, "")


def segments(body: str) -> list[str]:
    return [x.strip() for x in (_SPLIT if "。" in body else _SPLIT_BLANKS).split(body) if x and x.strip()]


class Line:
    """A line read once: presentation, body, link target, and its segments with digits masked and their ids, but for the bits of the kind."""

    __slots__ = ("kind", "body", "target", "link", "parts", "firsts", "ids")

    def __init__(self, raw: str) -> None:
        self.kind, body, self.target = parse(quick(raw))
        self.body = body
        self.link = LINK_BIT * bool(self.target)
        self.parts = [] if not body or self.kind == ">" else [body] if _running(body) else segments(body)
        self.firsts = [_DIGITS.sub("0", p) for p in self.parts]
        self.ids = [node_id(f) | self.link for f in self.firsts]

    def nodes(self) -> tuple[int, ...]:
        """Ids of its nodes as they stand."""
        bits = KIND_BITS.get(self.kind, 0)
        return tuple(i | bits for i in self.ids)


_MEMO: dict[str, tuple] = {}


def line_nodes(line: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Ids of the nodes of a line as they stand, and of those with a name masked; lines of furniture recur, so they are kept."""
    got = _MEMO.get(line)
    if got is None:
        read = Line(line)
        got = read.nodes(), () if read.kind == "#" else tuple(node_id(k) | read.link for f in read.firsts for k in masked(f))
        if len(line) <= MAX_LINE:
            if len(_MEMO) > 100_000:
                _MEMO.clear()
            _MEMO[line] = got
    return got


#: A line from this length on tells a page's content.
LONG = 60


def page_nodes(text: str | None) -> tuple[int, list[int], list[int]]:
    """A fingerprint of a page's content, its nodes, and its nodes with a name masked.

    The fingerprint is the least hash of its long lines (of all lines, if it has none), so that
    copies with small edits mostly have the same one.
    """
    if not text:
        return 0, [], []
    own: set[int] = set()
    names: set[int] = set()
    least = shortest = None
    fenced = False
    for line in text.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
            continue
        if line:
            h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
            if len(line) >= LONG:
                least = h if least is None or h < least else least
            shortest = h if shortest is None or h < shortest else shortest
        if not fenced and candidate(line):
            a, b = line_nodes(line)
            own.update(a)
            names.update(b)
    h = least if least is not None else shortest or 0
    return h - (1 << 63), list(own), list(names)


_NONE: frozenset = frozenset()


class Tree:
    """The nodes of low importance over all hosts, with the lines already judged by them."""

    def __init__(self, nodes=()) -> None:
        self.nodes = frozenset(nodes)
        self._judged: dict[str, tuple[tuple[int, bool, bool], tuple[int, ...]]] = {}
        self._own: frozenset = _NONE  # nodes of low importance on the host of the line being judged,
        self._sure: frozenset = _NONE  # and those of so low importance that sentences need no neighbour
        self._bits = self._link = 0

    def _known(self, first: str, h: int) -> int:
        """2 for a node of very low importance or a part of a sentence, 1 for one of low importance, else 0; of a segment with digits masked, and its id."""
        if h | self._bits in self._sure:
            return 2
        if h | self._bits in self._own or self._bits != KIND_BITS["#"] and (h in self.nodes or any(node_id(k) | self._link in self.nodes for k in masked(first))):
            return 1 if h & 1 else 2
        return 0

    def _known_words(self, seg: str) -> int:
        first = _DIGITS.sub("0", seg)
        return self._known(first, node_id(first) | self._link)

    def _made_of(self, seg: str, first: str | None = None, h: int = 0) -> int:
        """As above, also for a segment of a few such nodes side by side."""
        known = self._known_words(seg) if first is None else self._known(first, h)
        if known:
            return known
        words = () if seg.endswith(_STOPS) else seg.split()
        if 2 <= len(words) <= 8:
            for i in range(1, len(words)):
                if self._known_words(" ".join(words[:i])):
                    rest = " ".join(words[i:])
                    known = self._known_words(rest) or len(words) - i > 1 and self._made_of(rest)
                    if known:
                        return known
        return 0

    def _furniture(self, line: Line, ends: bool) -> int:
        """2 for furniture, 1 for a sentence that is furniture beside other furniture, else 0."""
        body, parts = line.body, line.parts
        if _running(body):
            known = self._known(line.firsts[0], line.ids[0])
        else:
            known = 2
            for part in zip(parts, line.firsts, line.ids):
                known = min(known, self._made_of(*part))
                if not known:
                    break
            if known and len(parts) > 1:
                known = 2  # several nodes side by side
        if known:
            if ends and known < 2:
                return 0 if _QUOTED.search(body) else 1
            return 2
        if ends or len(parts) < 2:
            return 0
        path = _BREAD.split(body)
        # a path: known nodes, then the name of the page
        return 2 * (len(path) >= 2 and len(path[-1]) <= 60 and all(self._made_of(p.strip()) for p in path[:-1] if p.strip()))

    def judge(self, raw: str, own: frozenset = _NONE, sure: frozenset = _NONE) -> tuple[int, bool, bool]:
        """As above, whether the line may belong to a list of links, and whether it ends like a sentence.

        ``own`` has the nodes of low importance on the line's host, with the bits of their kind,
        ``sure`` those of very low importance.
        """
        got = self._judged.get(raw)
        line = None
        if got is None:
            line = Line(raw)
            got = self._judge(line), line.nodes()
            if len(raw) <= MAX_LINE:
                if len(self._judged) > 100_000:
                    self._judged.clear()
                self._judged[raw] = got
        if got[0][0] < 2 and own and not own.isdisjoint(got[1]):
            self._own, self._sure = own, sure
            try:
                return self._judge(line or Line(raw))
            finally:
                self._own = self._sure = _NONE
        return got[0]

    def _judge(self, line: Line) -> tuple[int, bool, bool]:
        kind, body = line.kind, line.body
        self._bits = KIND_BITS.get(kind, 0)
        self._link = line.link
        ends = _ends(body)
        hit = 0 if kind == ">" or not body else self._furniture(line, ends)
        if kind == "#":
            return hit, False, ends
        if kind == "li" and ends:
            hit = min(hit, 1)
        if hit and (residue.scan(body)["stand_in"] or residue.unfilled(body)):
            hit = 0
        item = (kind == "li" or kind == "p" and len(body) <= 100) and (not ends or body[-1] in "?!？！")
        if item and not hit and kind == "p" and (residue.scan(body)["stand_in"] or residue.unfilled(body)):
            item = False
        return hit, item, ends


def host_hash(host: str) -> int:
    """Spark's xxhash64 of a host."""
    h = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def _own_link(raw: str, host: int | None) -> bool:
    """Whether a line is one link to another page of its own host."""
    if "](" not in raw:
        return False
    target = parse(quick(raw))[2]
    m = _HOST.match(target)
    if m:
        return host is not None and host_hash(m.group(1).lower()) == host
    return bool(target) and not target.startswith("#") and ":" not in target.split("/")[0]


def _link_runs(lines: list[str], taken: set[int], code: set[int], host: int | None) -> list[int]:
    """Runs of two or more links to pages of the same host that stand apart from the article.

    A run next to a line of the article, or below a heading or lead-in of it, is the article's.
    """
    out: list[int] = []
    at = 1
    while at <= len(lines):
        end = at
        while end <= len(lines) and end not in code and (end in taken or candidate(lines[end - 1])) and _own_link(lines[end - 1], host):
            end += 1
        if end - at >= 2:
            before, after = at - 1, end
            apart = (before < 1 or before in taken or not lines[before - 1].strip()) and (after > len(lines) or after in taken or not lines[after - 1].strip())
            while before >= 1 and not lines[before - 1].strip():
                before -= 1
            above = lines[before - 1].strip() if before >= 1 and before not in taken else ""
            if apart and not above.endswith((":", "：")) and parse(above)[0] not in ("#", "h"):
                out += [n for n in range(at, end) if n not in taken]
        at = max(end, at + 1)
    return out


def furniture_lines(text: str | None, tree: Tree, own: frozenset = _NONE, sure: frozenset = _NONE, host: int | None = None) -> list[int]:
    """Numbers, from 1, of the lines of a page that are furniture, by the ``own`` and ``sure`` nodes of its host and the tree of all hosts.

    A page that holds nothing else, or else only an error, filler or template text, has no
    article, and nothing of it is furniture.  A null, empty or blank text has no lines.
    """
    if not text or text.isspace():
        return []
    lines = text.split("\n")
    found: list[int] = []
    beside: list[int] = []
    code: set[int] = set()
    fenced = listing = False
    for number, raw in enumerate(lines, 1):
        if raw.startswith("```"):
            fenced = not fenced
            listing = False
        elif fenced or not candidate(raw):
            listing = False
            if fenced:
                code.add(number)
        elif not raw.isspace():
            hit, item, ends = tree.judge(raw, own, sure)
            if hit == 1:
                beside.append(number)
                listing = False
            elif hit or listing and item:
                listing = listing or not ends or item
                found.append(number)
            else:
                listing = False
        else:
            listing = False
    if beside:
        held = {*found, *beside}
        found += [n for n in beside if n - 1 in held or n + 1 in held]
        found.sort()
    if "](" in text:
        found = sorted(found + _link_runs(lines, {*found}, code, host))
    if not found:
        return []
    taken = set(found)
    main = "\n".join(line for number, line in enumerate(lines, 1) if number not in taken).strip()
    if not main or residue.classify(main) in ("error", "script", "filler", "template"):
        return []
    return found
