"""Garbled text from wrong character encodings: search and repair of one text.

The repair is a best-first graph search.  A state is a text (or, at the start of a payload,
its bytes); an edge re-encodes a text with the encoding it may have been decoded with by
mistake and decodes the bytes with the encoding they may really have, or undoes character
references or backslash escapes.  A priority queue ordered by the plausibility cost of
characters, plus the price of the path, takes the cheapest state first, and a set of state
hashes keeps any text from being expanded twice.  The search ends when no open state is
within :data:`SLACK` of the cheapest one found: a bound on cost, not on depth or number.

A text is garbled if the search reaches a clearly cheaper one, or if even the cheapest text
that it reaches holds the damage that decoders leave.  Letters cost little if they stand
together in the alphabet of any one language, so text of no script is taken for garbled
because the archive seldom has it.

Nothing here needs Spark; :mod:`lodestack.llm.encoding_repair` holds the DataFrame side.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
import unicodedata
from collections import Counter

#: Encodings by which a text may have been decoded by mistake.
WRONG = (
    "windows-1252", "cp1251", "cp932", "koi8-r", "mac-roman", "cp1250", "cp1254",
    "cp437", "cp850", "euc_jp", "gb18030", "mac-cyrillic", "cp866", "latin-1",
)
#: Encodings in which its bytes may really have been,
RIGHT = ("utf-8", "cp932", "euc_jp", "windows-1252", "cp1251", "koi8-r", "mac-roman")
#: and those looked for only behind a decoder of single bytes.
RIGHT_OF_BYTES = ("cp1250", "cp1253", "gb18030", "euc_kr", "big5")
#: Open states that cost more than the cheapest one by this are not expanded.
SLACK = 4.0
#: By how much the cost must fall for a text to count as garbled.
MIN_GAIN = 1.4


# Latin-1 passes C1 controls on; so do web browsers for the holes of windows-1252.
def _holes(name: str) -> dict[str, int]:
    found = {}
    for b in range(0x80, 0x100):
        try:
            bytes([b]).decode(name)
        except UnicodeDecodeError:
            found[chr(b)] = b
    return found


_HOLES = {n: _holes(n) for n in ("windows-1252", "cp1251", "cp1250", "cp1254")}
_C1 = re.compile("[\x80-\x9f]")


def _encode(text: str, name: str) -> bytes | None:
    """Bytes of text in an encoding; C1 controls stand for the holes of a code page."""
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        pass
    if name == "cp932":
        # windows-31j decoders map the unused single bytes to these private characters
        text = text.translate({0xF8F0: 0xA0, 0xF8F1: 0xFD, 0xF8F2: 0xFE, 0xF8F3: 0xFF})
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode("cp932")
            except UnicodeEncodeError:
                if ch in "\x80\xa0\xfd\xfe\xff":
                    out.append(ord(ch))
                else:
                    return None
        return bytes(out)
    holes = _HOLES.get(name)
    if not holes:
        return None
    out = bytearray()
    for part in re.split("([\x80-\x9f]+)", text):
        try:
            out += part.encode(name) if not _C1.match(part) else part.encode("latin-1")
        except UnicodeEncodeError:
            return None
    return bytes(out)


# --- character plausibility -------------------------------------------------------

# Russian letters from the most to the least frequent.
_RUSSIAN = "оеаинтсрвлкмдпуяызьбгчйхжюшцщэфёъ"
# Accented letters of the languages of the archive.
_ACCENTED = "éèêëàâçîïôùûüäößãõáíóúñœ"
# Letters beyond ASCII of further languages in Latin letters.
_LATIN_ALPHABETS = (
    "àèéìíîòóùú", "ąćęłńóśźż", "áčďéěíňóřšťúůýž", "áäčďéíĺľňóôŕšťúýž", "áéíóöőúüű", "ăâîșțşţ", "çğıi̇öşüâîû", "åäöæøéü", "áðéíóúýþæö", "āčēģīķļņšūž",
    "ąčęėįšųūž", "čćđšž", "äöõüšž", "àçèéíïòóúü", "âêîôûŵŷáàäëïöẃẁ", "ĉĝĥĵŝŭ", "ċġħż", "ëïéèöüáóíê", "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜü", "ẹọṣáàéèíìóòúùńǹ",
    "àáãèéìíòóõùúýăâđêôơưĩũ" + "".join(chr(o) for o in range(0x1EA1, 0x1EFA, 2)),
)
# Letters that other languages in Cyrillic letters add to the Russian ones, and those that they lack.
_CYRILLIC_ALPHABETS = (("іїєґ", "ыэёъ"), ("іў", "ищъ"), ("јљњћђџ", "йщъыьэюяё"), ("ѓѕќјљњџ", "йщъыьэюяё"), ("ъ", "ыэё"), ("әғқңөұүһі", ""), ("өү", ""), ("ҳқғӯӣҷў", ""))
# Greek letters from the most to the least frequent, and those with accents.
_GREEK_LETTERS, _GREEK_ACCENTED = "αοιετσνηυρπκμλςωδγχθφβξζψ", "άίόέήύώϊϋΐΰ"
_TYPOGRAPHY = "’‘“”„«»–—…•·›‹©№€£"
#: What the first letters of a language other than those of the archive cost, once a text.
_OTHER_LANGUAGE = 0.6


def _level(ch: str, name: str, last: int) -> int:
    """1 for the frequent ideographs of a double-byte standard, 2 for its others, 0 for none."""
    try:
        b = ch.encode(name)
    except UnicodeEncodeError:
        return 0
    return 0 if len(b) != 2 else 1 if b[0] <= last else 2


def _jis_level(ch: str) -> int:
    return _level(ch, "euc_jp", 0xCF)


# Japanese, simplified and traditional Chinese
_STANDARDS = (("euc_jp", 0xCF), ("gb2312", 0xD7), ("big5", 0xC6))


def _is_ideograph(o: int) -> bool:
    return 0x4E00 <= o <= 0x9FFF


def _is_latin(o: int) -> bool:
    return 0xC0 <= o < 0x250 and o not in (0xD7, 0xF7) or 0x1E00 <= o < 0x1F00


def _char_cost(ch: str) -> float:
    """Cost of a character beyond ASCII that is no ideograph, Latin, Cyrillic or Greek letter; those depend on the text."""
    o = ord(ch)
    if o < 0xA0:
        return 8.0
    if ch in _TYPOGRAPHY:
        return 0.3
    if 0x3041 <= o <= 0x3096 or o in (0x3001, 0x3002, 0x300C, 0x300D, 0x30FC, 0x3000):
        return 0.15
    if 0x30A1 <= o <= 0x30FB:
        return 0.25
    if 0xFF66 <= o <= 0xFF9F:
        return 0.6
    if 0xFF61 <= o <= 0xFF65:
        return 1.8
    if ch == "\xa0" or 0xFF01 <= o <= 0xFF5E or 0x3003 <= o <= 0x301F:
        return 0.5
    if ch in "²³°±×÷µ√∞≈≠≤≥∂∆∑∏∫−":
        return 0.6
    if ch in "½¼§™®₂★☆¿¡ºª":
        return 1.2
    if o == 0xFFFD:
        return 9.0
    if o == 0xAD:
        return 1.5
    if o < 0x100:
        return 1.8
    kind = unicodedata.category(ch)
    if 0xE000 <= o < 0xF900 or kind in ("Cn", "Co", "Cs"):
        return 8.0
    if 0x2500 <= o < 0x25A0:
        return 3.0
    if 0xAC00 <= o < 0xD7A4:
        return 0.7
    if kind[0] in "LM" and (0x530 <= o < 0x2000 or 0x2C00 <= o < 0x2E00 or 0xA000 <= o < 0xE000):  # a letter of any script with an alphabet of its own
        return 0.6 if kind == "Lu" else 0.3
    if o >= 0x1F000 or 0x2600 <= o < 0x2800:
        return 1.0  # pictures
    return 2.4


class _Costs(dict):
    def __missing__(self, ch: str) -> float:
        self[ch] = cost = _char_cost(ch)
        return cost


_COST = _Costs()
_WEST = frozenset(_ACCENTED + _ACCENTED.upper())
_LATIN = [(0.0, _WEST), *((_OTHER_LANGUAGE, frozenset(a + a.upper())) for a in _LATIN_ALPHABETS)]


class _LatinCosts(dict):
    """Of a Latin letter, what it costs where it belongs to the alphabet, and where not."""

    def __missing__(self, ch: str) -> tuple[float, float]:
        low = ch.lower()
        own = 0.3 if ch == low else 0.6
        self[ch] = got = (own, 1.8 if ord(ch) < 0x100 else 2.4)
        return got


_LATIN_COST = _LatinCosts()


def _latin_cost(letters: Counter) -> float:
    """The least cost of Latin letters beyond ASCII over all alphabets."""
    west = sum(n * _LATIN_COST[c][c not in _WEST] for c, n in letters.items())
    if letters.keys() <= _WEST:
        return west
    return min(west, *(prior + sum(n * _LATIN_COST[c][c not in own] for c, n in letters.items()) for prior, own in _LATIN[1:]))


def _cyrillic_table(more: str, fewer: str) -> dict[str, float]:
    table = {c: 0.15 + 0.03 * i for i, c in enumerate(_RUSSIAN)} | dict.fromkeys(more, 0.4) | dict.fromkeys(fewer, 2.0)
    return table | {c.upper(): k + 0.4 for c, k in table.items()}


_CYRILLIC_TABLES = [(0.0, _cyrillic_table("", "")), *((_OTHER_LANGUAGE, _cyrillic_table(*a)) for a in _CYRILLIC_ALPHABETS)]


def _cyrillic_cost(letters: Counter) -> float:
    russian = _CYRILLIC_TABLES[0][1]
    if letters.keys() <= russian.keys():
        return sum(n * russian[c] for c, n in letters.items())
    return min(prior + sum(n * table.get(c, 3.0) for c, n in letters.items()) for prior, table in _CYRILLIC_TABLES)


def _greek_table() -> dict[str, float]:
    table = {c: 0.15 + 0.03 * i for i, c in enumerate(_GREEK_LETTERS)} | dict.fromkeys(_GREEK_ACCENTED, 0.45)
    table |= dict.fromkeys((c for o in range(0x1F00, 0x2000) if (c := chr(o)).islower()), 0.6)
    return table | {c.upper(): k + 0.4 for c, k in table.items() if len(c.upper()) == 1}


_GREEK_TABLE = _greek_table()


class _Ideographs(dict):
    def __missing__(self, ch: str) -> tuple[float, ...]:
        self[ch] = got = tuple((3.2, 0.5, 2.0)[_level(ch, *s)] for s in _STANDARDS)
        return got


_IDEOGRAPH = _Ideographs()


def _ideograph_cost(letters: Counter, kana: int) -> float:
    """The least cost of ideographs over the standards; kana are Japanese."""
    sums = [sum(n * _IDEOGRAPH[c][i] for c, n in letters.items()) for i in range(3)]
    return min(sums[0], sums[1] + _OTHER_LANGUAGE + kana, sums[2] + _OTHER_LANGUAGE + kana)


def _letters(lower: bool) -> str:
    points = [o for o in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if unicodedata.category(chr(o)) == ("Ll" if lower else "Lu")]
    return "".join(map(chr, points))


_LOW, _UP = _letters(True), _letters(False)
_CJK = "ぁ-ヿ一-鿿"
_GREEK = "Ͱ-Ͽἀ-῿"
_LAT = f"A-Za-z{_LOW}{_UP}"
#: Places that a reader would stumble over, each with what it adds.
_ODD = (
    (re.compile(f"[a-z{_LOW}](?=[{_UP}])"), 1.2),
    (re.compile("[а-џ](?=[Ѐ-Я])|[ά-ώ](?=[Α-Ω])"), 0.9),
    (re.compile("ς(?=[Α-ώ])"), 1.5),
    (re.compile("(?<![Ͱ-Ͽἀ-῿])[Α-ώ](?![Ͱ-Ͽἀ-῿])"), 0.5),
    (re.compile(f"[{_UP}](?=[\xa0-¿‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ€\x80-\x9f])|[{_LOW}](?=[\xa0-¿‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™›Ÿ€\x80-\x9f])"), 1.2),
    (re.compile("[A-Za-zÀ-ÿ](?=[Ѐ-ӿ])|[Ѐ-ӿ](?=[A-Za-zÀ-ÿ])"), 1.3),
    (re.compile(f"[{_LAT}](?=[{_GREEK}])|[{_GREEK}](?=[{_LAT}Ѐ-ӿ])|[Ѐ-ӿ](?=[{_GREEK}])"), 2.0),
    (re.compile("(?<=[A-Za-z])[¤¦¨¬¯±´µ¶¸¹¼¾‚ƒ„†‡ˆ‰⌐αΓ](?=[A-Za-z])|(?<=[A-Za-z])[√∞≈≠≤≥∂∆∑∏π∫Ω◊]|[√∞≈≠≤≥∂∆∑∏∫Ω◊¬](?=[\xa0-¿√∞≈≠≤≥∂∆∑∏π∫Ω◊™ƒ])"), 1.5),
    (re.compile(f"(?<![{_CJK}])[{_CJK}](?![{_CJK}])"), 1.6),
    (re.compile(f"(?<=[a-z])[{_CJK}]{{1,3}}(?=[a-z])|(?<=[a-z])[{_CJK}]{{1,2}}(?![{_CJK}])"), 2.0),
    (re.compile("(?<![ｦ-ﾟ])[ｦ-ﾟ]{1,2}(?![ｦ-ﾟ])"), 2.0),
    (re.compile("(?<![A-Za-zÀ-ɏЀ-ӿͰ-ϿḀ-ỿ\u0300-\u036f])[\u0300-\u036f]|(?<![\u0591-\u06ff])[\u0591-\u05c7\u0610-\u061a\u064b-\u065f]"), 2.5),
    (re.compile(f"[ｦ-ﾟ](?=[{_CJK}])|[一-鿿](?=[ｦ-ﾟ])"), 1.2),
    (re.compile("(?<=[A-Za-z])[’‘“”„«»–](?=[A-ZÀ-Þ])|(?<=[a-z])[“„«»](?=[a-z])|(?<![A-Za-zÀ-ÿ ])[À-ÿ](?![A-Za-zÀ-ÿ ])"), 1.0),
    (re.compile(r"(?<=n)ít\b|(?<=[Tt])ís\b"), 2.0),
    (re.compile(r"В(?=[«»·©°§£])|‹(?=[a-zà-ÿ])|›(?=[^\W\d_])"), 1.5),
    (re.compile("[À-ÿ]{3}"), 1.5),
    (re.compile(f"[{_LAT}](?=[\u0531-\u10ff\u1780-\u1cff])|[\u0531-\u10ff\u1780-\u1cff](?=[{_LAT}])"), 2.0),
    (re.compile("[¬¦§¶¤±¢µ©®](?=[а-яё])|(?<=[а-яё])€|—(?=[А-яЁё])|•(?=[A-Za-z^_])|(?<=[a-z])»(?= )"), 1.5),
    (re.compile("(?<![A-Za-zÀ-ÿ])[à-ÿ](?=[A-Z])|(?<=[,.!?])[À-ÿ]|(?<= )[ìîíóñÐ](?= )"), 1.5),
    (re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,6}|#x[0-9A-Fa-f]{2,5});"), 2.5),
    (re.compile(r"\\u[0-9a-fA-F]{4}"), 3.0),
)
#: Lines of trees and tables, which stand apart from letters.
_DRAWN = re.compile(r"(?<!\S)(?:[│┃║](?!\S)|(?=[─-╿]*[─━═]{2})[─-╿]+)")


def _characters(text: str) -> float:
    """What the characters of a text cost, wherever they stand."""
    total = 0.0
    latin, cyrillic, ideographs, kana = Counter(), Counter(), Counter(), 0
    for ch, n in Counter(text).items():
        o = ord(ch)
        if o < 128:
            if o < 32 and ch not in "\n\t\r" or o == 127:
                total += 8.0 * n
        elif _is_latin(o):
            latin[ch] = n
        elif 0x400 <= o < 0x530:
            cyrillic[ch] = n
        elif _is_ideograph(o):
            ideographs[ch] = n
        elif 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
            total += n * _GREEK_TABLE.get(ch, 2.0)
        else:
            total += n * _COST[ch]
            if 0x3041 <= o <= 0x30FB or 0xFF66 <= o <= 0xFF9F:
                kana += n
    if latin:
        total += _latin_cost(latin)
    if cyrillic:
        total += _cyrillic_cost(cyrillic)
    if ideographs:
        total += _ideograph_cost(ideographs, kana)
    return total


def _places(text: str) -> float:
    """What the odd places of a text cost."""
    total = 0.0
    if any("─" <= c <= "╿" for c in text):
        total -= sum(2.7 * len(m.group()) for m in _DRAWN.finditer(text))
    for pattern, weight in _ODD:
        n = len(pattern.findall(text))
        if n:
            total += weight * n
    return total


def cost(text: str) -> float:
    """Implausibility of a text: 0 for plain ASCII, more the less it looks like writing of some language."""
    return _characters(text) + _places(text)


# --- which texts need no search -----------------------------------------------------


def _ideographs(level: set[int]) -> str:
    """A character class of the ideographs of these JIS levels."""
    chars = [o for o in range(0x4E00, 0xA000) if _jis_level(chr(o)) in level]
    out, start = [], None
    for o, nxt in zip(chars, [*chars[1:], 0]):
        start = o if start is None else start
        if nxt != o + 1:
            out.append(chr(start) if start == o else f"{chr(start)}-{chr(o)}")
            start = None
    return "".join(out)


_LO = "a-zß-öø-ÿœšž"
_CONT = "\x80-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™"
# scripts that no decoder of WRONG makes out of the bytes of others, and pictures
_APART = "\u0531-\u10ff\u1100-\u1cff\u1ea0-\u1fff\uac00-\ud7a3\uff01-\uff60\U0001f000-\U0001faff"
_NORMAL = f"\n\t\r -~{_TYPOGRAPHY}{_ACCENTED}{_ACCENTED.upper()}А-яЁё{_CJK}、。「」・（）　々？！：Ά-ώ{_APART}"
#: Anything that occurs in garbled text and seldom in sound text, by what a line must hold for it.  Each
#: begins at a sign that is rare there, with what stands before it looked back at, so a search skips the rest.
_UNUSUAL = re.compile(f"[^{_NORMAL}]")
_SUSPECT = (
    (re.compile("[À-ÿŒŠŸŽ]"), re.compile(
        f"[À-ÿŒŠŸŽ](?:(?<=[Â-ß])[{_CONT}]|(?<=[à-ï])[{_CONT}]{{2}}|(?<=[{_LO}][À-ÖØ-ÞŒŠŸŽ])|(?<=ní)t\\b|(?<=[Tt]í)s\\b|(?<=[À-ÿ])[À-ÿ]{{2}}"
        f"|(?<=[à-ÿ])(?<![A-Za-zÀ-ÿ][à-ÿ])[A-Z]|(?<=[,.!?][À-ÿ]))"
    )),
    (re.compile("[Ѐ-ӿ]"), re.compile(
        f"[А-ЯЁ«»·©°§£€—A-Za-zÀ-ÿ](?:(?<=[а-яё][А-ЯЁ])|(?<=В[«»·©°§£])|(?<=[а-яё]€)|(?<=—)[А-яЁё]|(?<=[A-Za-zÀ-ÿ])[Ѐ-ӿ]|(?<=[Ѐ-ӿ][A-Za-zÀ-ÿ]))"
    )),
    (re.compile("[一-鿿]"), re.compile(
        f"[a-z{_ideographs({0, 2})}](?:(?<=[{_ideographs({0})}])|(?<=[{_ideographs({2})}])[{_ideographs({2})}]|(?<=[a-z])[一-鿿]{{1,2}}(?![{_CJK}]))"
    )),
    (re.compile("[Ά-ώ]"), re.compile(f"[Ά-ώ](?:(?<=[A-Za-zÀ-ÿ][Ά-ώ])|[A-Za-zÀ-ÿ]|(?<![{_GREEK}][Ά-ώ])(?![{_GREEK}]))")),
    (re.compile(r"[‹›&\\]"), re.compile(r"‹[a-zà-ÿ]|›[A-Za-z]|&(?:[A-Za-z]{2,8}|#\d{2,6}|#[xX][0-9A-Fa-f]{2,5});|\\u[0-9a-fA-F]{4}")),
)
_CYRILLIC = re.compile("[А-яЁё]{3,}")
_RUSSIAN_COST = {c: _CYRILLIC_TABLES[0][1][c.lower()] for c in map(chr, range(0x400, 0x460)) if _CYRILLIC.match(3 * c)}


def _swapped(text: str) -> bool:
    """Whether the letters of Cyrillic words are those of another text's code page."""
    words = _CYRILLIC.findall(text)
    letters = sum(map(len, words))
    return letters >= 5 and sum(map(_RUSSIAN_COST.__getitem__, "".join(words))) > (0.52 if letters > 30 else 0.62) * letters


def calm(text: str) -> bool:
    """Whether nothing in a text hints at a wrong encoding."""
    return _UNUSUAL.search(text) is None and not any(has.search(text) and odd.search(text) for has, odd in _SUSPECT) and not _swapped(text)


# --- search -----------------------------------------------------------------------

_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,6}|#[xX][0-9A-Fa-f]{2,5});")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
#: What an operation costs.
_STEP = {"utf-8": 0.3, "utf-8, parts": 0.5, "utf-8, lossy": 0.5, "unescape": 0.3}
_OTHER_STEP = 1.0
#: What valid UTF-8, which is rarely a coincidence, takes off for each sequence, and at most.
_CREDIT, _MOST_CREDIT = 0.4, 3.0
#: How much cheaper an edge is that undoes the encoding that a record names; half as much if it leads there.
_NAMED = 0.7
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_FOUR_BYTES = re.compile(rb"[\x81-\xfe][0-9][\x81-\xfe][0-9]")
_HIGH = re.compile(rb"[\x80-\xff]")
_RUN = re.compile("[^\x00-\x7f]+")
_LOST = re.compile("\ufffd+")
_SINGLE_BYTE = frozenset(("windows-1252", "cp1251", "koi8-r", "mac-roman", "cp1250", "cp1254", "cp437", "cp850", "mac-cyrillic", "cp866", "latin-1"))


def _parts(text: str, wrong: str) -> str:
    """A text whose runs outside ASCII are read as UTF-8 where they are it."""

    def read(m: re.Match) -> str:
        if len(m.group()) < 2 or "\ufffd" in m.group():
            return m.group()
        raw = _encode(m.group(), wrong)
        if raw is None:
            return m.group()
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _RUN.sub(read, text)


def _lossy(text: str, wrong: str) -> str | None:
    """A text read as UTF-8 though some of its bytes are lost; None if hardly any of it is UTF-8."""
    parts = []
    for part in _LOST.split(text):
        raw = _encode(part, wrong)
        if raw is None:
            return None
        parts.append(raw)
    raw = b"\xff".join(parts)
    if 3 * len(_SEQUENCE.findall(raw)) + raw.count(b"\xff") < 0.6 * len(_HIGH.findall(raw)):
        return None
    return _LOST.sub("\ufffd", raw.decode("utf-8", "replace"))


def apply(text: str, path: tuple) -> str | None:
    """A text after a sequence of operations, None if one of them can't be done."""
    for wrong, right in path:
        if right == "unescape":
            text = html.unescape(text) if wrong == "entity" else _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
            continue
        if right in ("utf-8, parts", "utf-8, lossy"):
            got = _parts(text, wrong) if right == "utf-8, parts" else _lossy(text, wrong)
            if got is None:
                return None
            text = got
            continue
        raw = _encode(text, wrong)
        if raw is None:
            return None
        try:
            text = raw.decode(right)
        except UnicodeDecodeError:
            return None
    return text


def _encodable(name: str) -> frozenset[str]:
    """The characters beyond ASCII that an encoding of one or two bytes has, and those that _encode adds."""
    if name in _SINGLE_BYTE:
        return frozenset(bytes(range(0x80, 0x100)).decode(name, "ignore")) | (frozenset(map(chr, range(0x80, 0xA0))) if name in _HOLES else frozenset())
    found = set(bytes(range(0x80, 0x100)).decode(name, "ignore"))
    for lead in range(0x80, 0x100):
        for trail in range(0x40, 0x100):
            try:
                found.update(bytes((lead, trail)).decode(name))
            except UnicodeDecodeError:
                continue
    if name == "euc_jp":
        found.update(bytes((0x8F, x, y)).decode(name, "ignore") for x in range(0xA1, 0xFF) for y in range(0xA1, 0xFF))
    return frozenset(c for c in found if not c.isascii()) | frozenset("\x80\xa0\xfd\xfe\xff\uf8f0\uf8f1\uf8f2\uf8f3" if name == "cp932" else "")


_ENCODABLE: dict[str, frozenset[str]] = {}


def _outside_ascii(text: str) -> set[str]:
    return {c for c in set(text) if not c.isascii()}


def _whole(text: str) -> list[tuple[str, bytes]]:
    """The encodings that have all characters of a text, with its bytes in them."""
    chars = _outside_ascii(text)
    if not chars or "\ufffd" in chars:
        return []
    if not _ENCODABLE:
        _ENCODABLE.update((n, _encodable(n)) for n in WRONG if n != "gb18030")
    out = []
    for wrong in WRONG:
        if wrong == "gb18030" or chars <= _ENCODABLE[wrong]:
            raw = _encode(text, wrong)
            # gb18030 has all characters, but hardly any bytes are read as its sequences of four
            if raw is not None and not (wrong == "gb18030" and _FOUR_BYTES.search(raw)):
                out.append((wrong, raw))
    return out


def _plain_moves(text: str):
    """Unescaping, and reading as UTF-8, which rarely succeeds by coincidence, with what comes out."""
    if _ENTITY.search(text):
        yield ("entity", "unescape"), html.unescape(text)
    if _ESCAPE.search(text):
        yield ("escape", "unescape"), apply(text, (("escape", "unescape"),))
    for wrong, raw in _whole(text):
        try:
            got = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if got != text:
            yield (wrong, "utf-8"), got


def _partial_moves(text: str):
    """Reading parts of a text as UTF-8, or a text of which some bytes are lost."""
    chars = _outside_ascii(text)
    if len(chars) < 2:
        return
    if not _ENCODABLE:
        _whole("é")
    for wrong in WRONG:
        if wrong != "gb18030" and len(chars & _ENCODABLE[wrong]) < 2:
            continue
        got = _lossy(text, wrong)
        if got is not None and got != text:
            yield (wrong, "utf-8, lossy"), got
        elif wrong != "gb18030":
            got = _parts(text, wrong)
            if got != text:
                yield (wrong, "utf-8, parts"), got


def _other_moves(text: str):
    """All other readings, with what comes out."""
    seen = set()
    for wrong, raw in _whole(text):
        if raw in seen:
            continue
        seen.add(raw)
        try:
            raw.decode("utf-8")
            continue  # no other reading of bytes that are valid UTF-8
        except UnicodeDecodeError:
            pass
        for right in RIGHT[1:] + RIGHT_OF_BYTES * (wrong in _SINGLE_BYTE):
            if right == wrong:
                continue
            try:
                got = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if got != text:
                yield (wrong, right), got


def _price(op: tuple[str, str], before: str, after: str, path: tuple, named: str | None) -> float:
    """What an operation adds to the price of a path."""
    if op[1] in _STEP:  # the more sequences were valid UTF-8, the less it is a coincidence
        price = _STEP[op[1]] - min(_MOST_CREDIT, _CREDIT * (len(before) - len(after)))
    else:
        price = _OTHER_STEP if all(o[1] in _STEP for o in path) else 3 * _OTHER_STEP
    return price if named is None else price - _NAMED * (1.0 if op[0] == named else 0.5 if op[1] == named else 0.0)


def search(start: str | bytes, named: str | None = None, candidates: tuple[str, ...] = ()) -> tuple[str, float, float, tuple]:
    """The cheapest text that can be reached, its cost with the price of the path, the cost of the given text, and the path.

    ``start`` may be bytes: then the first edges decode them by the candidates, and the cost of
    the start is infinite.  ``named`` is the decoder that the record names as its encoding.
    A state whose cheap edges lead to sound text, or which is UTF-8 in three places or more and
    cheaper as such, is not expanded by the others.
    """
    heap: list[tuple] = []  # cost with price, order, price, cost, text, path
    if isinstance(start, bytes):
        first = least = float("inf")
        best, by, seen = start.decode("latin-1"), (), set()
        for tick, name in enumerate(candidates):
            try:
                text = start.decode(name)
            except UnicodeDecodeError:
                continue
            k = _characters(text)
            if k > least + SLACK + 1:
                continue
            k += _places(text)
            seen.add(hash(text))
            heapq.heappush(heap, (k, tick, 0.0, k, text, (("bytes", name),)))
            if k < least:
                best, least, by = text, k, (("bytes", name),)
            if name == "utf-8":
                break  # hardly any other text is valid UTF-8
        tick = len(candidates)
    else:
        first = least = cost(start)
        best, by, seen, tick = start, (), {hash(start)}, 0
        heap.append((first, 0, 0.0, first, start, ()))
    while heap:
        k, _, spent, own, state, path = heapq.heappop(heap)
        if path and k > least + SLACK:
            break  # all others cost even more
        if path and state is best and calm(state):
            break  # sound, and nothing cheaper is open
        for moves in (_plain_moves, _partial_moves, _other_moves):
            told = False
            for op, new in moves(state):
                h = hash(new)
                if h in seen:
                    continue
                seen.add(h)
                paid = spent + _price(op, state, new, path, named)
                there = _characters(new)
                if there + paid > least + SLACK + 1:
                    continue  # odd places only add, but for drawn lines
                there += _places(new)
                tick += 1
                told = told or op[1] == "utf-8" and len(state) - len(new) >= 3 and there < own
                if there + paid < least:
                    best, least, by = new, there + paid, (*path, op)
                # a second and later step must lead to a cheaper text, so every path ends
                if there + paid <= least + SLACK and (not path or there < own):
                    heapq.heappush(heap, (there + paid, tick, paid, there, new, (*path, op)))
            if told or best is not state and by[:-1] == path and by != path and calm(best):
                break  # the bytes are UTF-8, or a cheap edge led to sound text
    return best, least, first, by


# --- texts of records -------------------------------------------------------------

_BACKTICKS = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
#: What decoders leave of bytes that they cannot read.
_DAMAGE = re.compile("[\ufffd\x80-\x9f\ue000-\uf8ff]")


#: Usual readings, for callers that need a guess and no search.
_USUAL = (
    *(((wrong, "utf-8"),) for wrong in WRONG),
    (("windows-1252", "utf-8"), ("windows-1252", "utf-8")), (("windows-1252", "cp1251"),), (("cp1251", "koi8-r"),), (("koi8-r", "cp1251"),), (("windows-1252", "koi8-r"),),
    (("latin-1", "cp932"),), (("windows-1252", "cp932"),), (("windows-1252", "euc_jp"),), (("cp932", "euc_jp"),), (("mac-roman", "windows-1252"),), (("mac-cyrillic", "cp1251"),), (("cp437", "windows-1252"),), (("cp850", "windows-1252"),),
)


def quick(line: str) -> str:
    """A line as the first usual reading of it that looks sound; itself if there is none."""
    if line.isascii() or calm(line) or "\ufffd" in line:
        return line
    for path in _USUAL:
        got = apply(line, path)
        if got is not None and got != line and calm(got):
            return got
    return line


_SCRIPTS = (re.compile("[Ѐ-ӿ]"), re.compile(f"[{_GREEK}]"), re.compile(f"[{_CJK}]"), re.compile("[\u0590-\u1cff\uac00-\ud7a3]"))


def _scripts(text: str) -> set[int]:
    return {i for i, p in enumerate(_SCRIPTS) if p.search(text)}


_MEMO: dict[tuple[str, str | None], tuple[bool, str, tuple]] = {}


def judge_line(line: str, named: str | None = None) -> tuple[bool, str, tuple]:
    """Whether the search finds a line garbled, the cheapest text that it reaches, and the path to it (empty if nothing is restored)."""
    key = (line, named)
    got = _MEMO.get(key)
    if got is None:
        best, least, first, path = search(line, named)
        gain, sound = first - least, bool(path) and calm(best)
        # a few better letters are enough, unless they are of another script
        few = sound and gain >= 0.3 * MIN_GAIN and (path[0][0] == named or all(op[1] in ("utf-8", "unescape") for op in path) or _scripts(best) <= _scripts(line))
        if path and (few or gain >= MIN_GAIN and (sound or least <= 0.75 * first)):
            got = True, best, path
        else:
            got = _DAMAGE.search(best) is not None, line, ()
        if len(line) <= 240:  # lines of furniture recur
            if len(_MEMO) >= 50_000:
                _MEMO.clear()
            _MEMO[key] = got
    return got


def examine(text: str | None, encoding: str | None = None) -> tuple[bool, str | None]:
    """Whether a text is garbled anywhere, and the text with what could be restored.

    ``encoding`` is the encoding that the record names, by which the text was read.  Examples
    between backticks don't count and stay as they are.  A null or empty text is sound.  A
    garbled text of which nothing can be restored comes back unchanged.
    """
    if not text or (text.isascii() and "&" not in text and "\\u" not in text) or calm(text):
        return False, text
    lines = text.split("\n")
    named = codec(encoding)
    named = _WRONG_OF.get(named, named)
    garbled, fenced = False, False
    for i, line in enumerate(lines):
        if line.startswith("```"):
            fenced = not fenced
            continue
        if fenced or calm(line):
            continue
        quoted = "`" in line
        bare = _BACKTICKS.sub("``", line) if quoted else line
        if quoted and calm(bare):
            continue
        bad, fixed, path = judge_line(bare, named)
        if bad:
            garbled = True
            if path and not quoted:
                lines[i] = fixed
    return garbled, "\n".join(lines) if garbled else text


# --- bytes with a declared charset ------------------------------------------------

# Names by which web pages mean another decoder than the name's own.
_ALIASES = {
    "iso-8859-1": "windows-1252", "latin-1": "windows-1252", "latin1": "windows-1252", "us-ascii": "windows-1252",
    "ascii": "windows-1252", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932",
    "windows-31j": "cp932", "ms_kanji": "cp932", "x-euc-jp": "euc_jp", "macintosh": "mac-roman",
    "x-mac-roman": "mac-roman", "x-mac-cyrillic": "mac-cyrillic", "cp1252": "windows-1252", "utf8": "utf-8",
}
_CANDIDATES = ("utf-8", "cp932", "euc_jp", "windows-1252", "cp1251", "koi8-r", "mac-roman", "cp1250", "cp1253", "cp437", "cp850", "cp866", "gb18030", "euc_kr", "big5")


def codec(charset: str | None) -> str | None:
    """Python's decoder for a declared charset, None if there is no such decoder."""
    name = (charset or "").strip().strip("\"'").lower()
    if not name:
        return None
    name = _ALIASES.get(name, name)
    try:
        return codecs.lookup(name).name
    except LookupError:
        return None


#: Names of WRONG by the names that Python gives its decoders.
_WRONG_OF = {codecs.lookup(n).name: n for n in WRONG}


def wrong_charset(raw: bytes | None, charset: str | None) -> tuple[bool, str | None]:
    """Whether bytes don't decode to their text by the charset, and the text they hold.

    The search starts at the bytes: its first edges are the candidate decoders, and it goes on
    as with texts.  The decoder of the cheapest path is the right one.  An empty charset claims
    nothing, and ASCII reads alike under every charset here: both are sound.  A charset without
    decoder, for bytes outside ASCII, is wrong.
    """
    if raw is None:
        return False, None
    if raw.isascii():
        return False, raw.decode("ascii")
    declared = codec(charset)
    told = b"\n".join(line for line in raw.split(b"\n") if not line.isascii())  # lines in ASCII tell nothing
    _, least, _, path = search(told, candidates=_CANDIDATES)
    best = (apply(raw.decode(path[0][1], "replace"), path[1:]) or raw.decode(path[0][1], "replace")) if path else raw.decode(declared or "latin-1", "replace")
    if not charset or not charset.strip():
        return False, best
    if not path:
        return declared is None, best
    if declared is None:
        return True, best
    try:
        said = told.decode(declared)
    except UnicodeDecodeError:
        return True, best
    if said == told.decode(path[0][1]):
        return False, best
    gain = cost(said) - least
    if path[0][1] == "utf-8":  # valid UTF-8 is rarely a coincidence
        gain += min(_MOST_CREDIT, _CREDIT * len(_SEQUENCE.findall(told)))
    return gain >= MIN_GAIN or gain >= 0.3 * MIN_GAIN and calm(best) and not calm(said), best
