"""Visually identical text: a compiled transducer to one consistent form.

One table is compiled from Unicode's own properties and a few fixed values.  Its rules map
sequences of code points: widths, spaces, hyphens, invisible characters, ligatures, second
codes, voiced kana, accents (a base and its marks in any order, composed as far as can be) and, by the
script of the word around them, look-alike letters, ideographs and kana.  The table is checked for
conflicts: in one context a source has one target, and a target is its own target.

The transducer reads a text once, cluster by cluster (a base with the marks, voicing signs and
invisible characters after it), and takes the longest source at each place.  For a letter it
writes one output a context (Latin, Cyrillic, Greek), and keeps that of the context that the whole word
allows when the word ends.
"""

from __future__ import annotations

import itertools
import re
import unicodedata

import regex

ZWNJ, ZWJ = "‌", "‍"

# --- fixed values -------------------------------------------------------------------
# Letters that look like those of another script, by the script of the word that they stand in.
LATIN, CYRILLIC, GREEK = "L", "C", "G"
LOOK_ALIKES = {
    LATIN: dict(zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυχϲϹϳ" "АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝӏүҮѵԌԚԜёЁїЇ" "օոսհցզյՕՍՏԼ" "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ" "ɡᴄᴏᴠᴡᴢꜱ",
        "ABEZHIKMNOPTYXayikvopuxcCj" "ABEKMHOPCTYXSIJaeopcyxsijhdqwlyYvGQWëËïÏ" "onuhgqjOUSL" "ABCDEGHJKLMPRSTVWZ" "gcovwzs", strict=True,
    )),
    CYRILLIC: dict(zip("ABEKMHOPCTYXaeopcyxëË" "ΑΒΕΗΚΜΟΡΤΧο", "АВЕКМНОРСТУХаеорсухёЁ" "АВЕНКМОРТХо", strict=True)),
    GREEK: dict(zip("ABEZHIKMNOPTYXvo", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο", strict=True)),
}
# Ideographs that look like katakana.
IDEOGRAPH_AS_KATAKANA = dict(zip("一工口八卜力夕二", "ーエロハトカタニ", strict=True))
# Katakana that look like ideographs and hardly ever stand alone between two of them.
KATAKANA_AS_IDEOGRAPH = dict(zip("エロタ", "工口夕", strict=True))
# Radicals without a decomposition in Unicode that look like ideographs.
RADICAL_AS_IDEOGRAPH = dict(zip("⺟⺠⻁⻄⻅⻆⻉⻋⻑⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻫⻬⻭⻮⻯⻰⻱⻲", "母民虎西见角贝车長长门青韦页风飞食马骨鬼鱼鸟麦黄斉齐歯齿竜龙龜亀", strict=True))
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0                　"
HYPHENS = "‐‑﹣－"
# Characters that show nothing though Unicode does not class them as format characters.
BLANKS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"


# Voicing signs after a kana: combining, spacing and half-width.
_VOICING = "\u3099\u309a\u309b\u309c\uff9e\uff9f"


class ConflictError(ValueError):
    """A source with two targets, or a target that is itself a source."""


def _tagged(ch: str) -> str:
    d = unicodedata.decomposition(ch)
    return d[1 : d.index(">")] if d.startswith("<") else ("canonical" if d else "")


def _width_rules():
    for o in range(0x80, 0x30000):
        ch = chr(o)
        if ch in SPACES or ch in HYPHENS or ch in BLANKS or 0xAC00 <= o < 0xE000 or 0x3400 <= o < 0xA000:
            continue
        tag = _tagged(ch)
        if tag in ("wide", "narrow", "small"):
            yield "width", ch, unicodedata.normalize("NFKC", ch)
        elif tag in ("isolated", "initial", "medial", "final") or tag == "compat" and (0xFB00 <= o < 0xFB50 or ch in "ĲĳǄǅǆǇǈǉǊǋǌǱǲǳ"):
            yield "ligature", ch, unicodedata.normalize("NFKC", ch)
        elif tag == "compat" and (0x2E80 <= o < 0x2FE0 or ch == "µ") or tag == "font" and 0x1D400 <= o < 0x1D800:
            yield "code", ch, unicodedata.normalize("NFKC", ch)
        elif tag == "canonical" and unicodedata.normalize("NFC", ch) != ch:
            yield "code", ch, unicodedata.normalize("NFC", ch)
    for ch, target in RADICAL_AS_IDEOGRAPH.items():
        yield "code", ch, target


def _blank_rules():
    for ch in SPACES:
        yield "space", ch, " "
    for ch in HYPHENS:
        yield "hyphen", ch, "-"
    for o in [*range(0x80, 0x3100), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xFFF0, 0xFFFC), *range(0xE0000, 0xE0200)]:
        ch = chr(o)
        if unicodedata.category(ch) == "Cf" and not 0x600 <= o <= 0x605 and o not in (0x6DD, 0x70F, 0x8E2) or 0xFE00 <= o < 0xFE10 or 0xE0100 <= o < 0xE01F0:
            yield "invisible", ch, ""
    for ch in BLANKS:
        yield "invisible", ch, ""


def _kana_rules():
    for o in [*range(0x3041, 0x30FF), *range(0xFF66, 0xFF9E)]:  # kana with a voicing sign after it
        base = unicodedata.normalize("NFKC", chr(o))
        for sign, mark in zip(_VOICING, "゙゚" * 3, strict=True):
            voiced = unicodedata.normalize("NFC", base + mark)
            if len(voiced) == 1:
                yield "voiced", chr(o) + sign, voiced


def _accent_rules():
    """Every base with marks that has a code of its own: composed in part or not at all, of any width, marks in any order that means the same."""
    wide = {chr(o - 0xFEE0): chr(o) for o in range(0xFF01, 0xFF5F)}
    for o in [*range(0xC0, 0x3400), *range(0xF900, 0xFB50), *range(0x11000, 0x12000)]:
        ch = chr(o)
        if _tagged(ch) != "canonical" or unicodedata.normalize("NFC", ch) != ch:
            continue
        full = unicodedata.normalize("NFD", ch)
        base, marks = full[0], full[1:]
        orders = [p for p in itertools.permutations(marks) if unicodedata.normalize("NFC", base + "".join(p)) == ch]
        for order in orders:
            for k in range(len(order)):  # the first k marks may be composed with the base already
                head = unicodedata.normalize("NFC", base + "".join(order[:k]))
                if len(head) == 1:
                    for start in {head, wide.get(head, head)}:
                        yield "accent", start + "".join(order[k:]), ch


def compile_mapping(rules=None) -> dict[str, str]:
    """Source to target wherever it stands, after the check for conflicts."""
    table: dict[str, str] = {}
    for kind, source, target in rules if rules is not None else itertools.chain(_width_rules(), _blank_rules(), _kana_rules(), _accent_rules()):
        if source == target:
            continue
        if table.setdefault(source, target) != target:
            raise ConflictError(f"{kind}: {source!r} would become {table[source]!r} and {target!r}")
    for source, target in table.items():
        again = "".join(table.get(c, c) for c in target)
        if again != target:
            if "".join(table.get(c, c) for c in again) != again:
                raise ConflictError(f"{source!r} becomes {target!r}, which becomes {again!r}")
            table[source] = again
    return table


def compile_contexts(everywhere: dict[str, str]) -> dict[str, dict[str, str]]:
    """The look-alikes of each context, after the same check against each other and the rules that hold everywhere."""
    for context, table in LOOK_ALIKES.items():
        for source, target in table.items():
            if source in everywhere or target in everywhere:
                raise ConflictError(f"{source!r} or {target!r} has another target everywhere")
            if target in table:
                raise ConflictError(f"{source!r} becomes {target!r} in {context}, which becomes {table[target]!r}")
    if set(IDEOGRAPH_AS_KATAKANA.values()) & everywhere.keys() or set(KATAKANA_AS_IDEOGRAPH.values()) & everywhere.keys():
        raise ConflictError("a kana or an ideograph has another target everywhere")
    return LOOK_ALIKES


MAPPING = compile_mapping()
CONTEXTS = compile_contexts(MAPPING)
#: Code points of the longest source.
LONGEST = max(map(len, MAPPING))
_INVISIBLE = frozenset(s for s, t in MAPPING.items() if t == "")
_VOICING = "゙゚゛゜ﾞﾟ"


def _char_class(chars) -> str:
    """A character class of single characters, as ranges."""
    points, out, start = sorted({ord(c) for c in chars}), [], None
    for o, nxt in zip(points, [*points[1:], 0]):
        start = o if start is None else start
        if nxt != o + 1:
            a, b = re.escape(chr(start)), re.escape(chr(o))
            out.append(a if start == o else f"{a}-{b}")
            start = None
    return "".join(out)


_SINGLE = _char_class(s for s in MAPPING if len(s) == 1)
_KATA = "ァ-ヺー-ヿ"
_LOOK = "".join(IDEOGRAPH_AS_KATAKANA)
_OTHER = r"\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}ɡᴄᴏᴠᴡᴢꜱ"
#: Whether a text can hold anything that the transducer changes.
_TRIGGER = regex.compile(
    rf"[{_SINGLE}{_VOICING}\p{{M}}]|[\p{{Latin}}--[ɡᴄᴏᴠᴡᴢꜱ]][{_OTHER}]|[{_OTHER}][\p{{Latin}}--[ɡᴄᴏᴠᴡᴢꜱ]]"
    rf"|\p{{Greek}}\p{{Cyrillic}}|\p{{Cyrillic}}\p{{Greek}}|[{_KATA}][{_LOOK}]|\p{{Han}}[{''.join(KATAKANA_AS_IDEOGRAPH)}]\p{{Han}}",
    regex.V1,
)
#: The same as a Java pattern for what is surely consistent, to keep such rows in the JVM.
PLAIN_JAVA = "[ -~]*"
_CLUSTER = regex.compile(rf"(?s)(.)([\p{{M}}{_VOICING}{_char_class(_INVISIBLE)}]*)")
_LEADING = regex.compile(rf"[{_char_class(_INVISIBLE)}]+")
_ARABIC = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Nko}\p{Mandaic}]")
_PICTURE = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}]")
_HAN = r"\p{Han}"
_KATA_RUN = regex.compile(f"(?<=[{_KATA}])[{_LOOK}]+(?=[{_KATA}])|(?<=[\\p{{Han}}--[{_LOOK}]])[{''.join(KATAKANA_AS_IDEOGRAPH)}](?=\\p{{Han}})", regex.V1)
_ANY_LOOK = frozenset(_LOOK) | KATAKANA_AS_IDEOGRAPH.keys()


class _Scripts(dict):
    """The script of a letter that has look-alikes: L, C, G, another one's that looks Latin (O), M for marks, else none, as letters of phonetic notation."""

    def __missing__(self, ch: str) -> str:
        if ch in CONTEXTS[LATIN] and not regex.match(r"[\p{Greek}\p{Cyrillic}]", ch):
            s = "O"
        else:
            s = "" if 0x250 <= ord(ch) < 0x2B0 else LATIN if regex.match(r"\p{Latin}", ch) else GREEK if regex.match(r"\p{Greek}", ch) else CYRILLIC if regex.match(r"\p{Cyrillic}", ch) else ""
        if not s and unicodedata.category(ch) == "Mn":
            s = "M"
        self[ch] = s
        return s


_SCRIPT = _Scripts()


class _Word:
    """A word as it is read: one output for each context that can still hold all of its letters."""

    __slots__ = ("as_is", "contexts", "counts", "mixed")

    def __init__(self) -> None:
        self.as_is: list[str] = []
        self.contexts: dict[str, list[str]] = {c: [] for c in CONTEXTS}
        self.counts = {LATIN: 0, CYRILLIC: 0, GREEK: 0, "O": 0, "M": 0}
        self.mixed = False

    def add(self, letter: str, script: str) -> None:
        if self.as_is and script != "M" and not self.counts[script]:
            self.mixed = True
        self.as_is.append(letter)
        self.counts[script] += 1
        for context in list(self.contexts):
            if script in (context, "M"):
                self.contexts[context].append(letter)
            elif (target := CONTEXTS[context].get(letter)) is not None:
                self.contexts[context].append(target)
            else:
                del self.contexts[context]

    def written(self) -> list[str]:
        """The output of the script that most of the letters have, of those that the word holds; Latin on a tie."""
        if not self.mixed:
            return self.as_is
        held = [c for c in self.contexts if self.counts[c]]
        if not held:  # letters of two other scripts that all look Latin
            return self.contexts.get(LATIN, self.as_is)
        return self.contexts[max(held, key=lambda c: (self.counts[c], c == LATIN))]


def _map_cluster(cluster: str) -> str:
    """The consistent form of one cluster without its invisible characters: at each place the longest source wins."""
    out: list[str] = []
    at = 0
    while at < len(cluster):
        for k in range(min(LONGEST, len(cluster) - at), 0, -1):
            hit = MAPPING.get(cluster[at : at + k])
            if hit is not None:
                out.append(hit)
                at += k
                break
        else:
            out.append(cluster[at])
            at += 1
    done = "".join(out)
    # marks beyond those of the longest source: in canonical order, each composed with what stands before it if it can be
    if len(done) > 1 and len(cluster) > 1:
        done = _composed(done)
    return done


#: The base and marks of each accented letter that the table writes.
_PARTS = {t: unicodedata.normalize("NFD", t) for s, t in MAPPING.items() if len(t) == 1 and len(s) > 1 and unicodedata.combining(s[-1])}


def _composed(cluster: str) -> str:
    """A base with marks that no source has as a whole: marks in canonical order, each composed with the base if a pair has a code."""
    out: list[str] = []
    kept: list[str] = []  # marks after the last base that stay by themselves
    for _, group in itertools.groupby("".join(_PARTS.get(c, c) for c in cluster), key=lambda c: unicodedata.combining(c) > 0):
        for m in sorted(group, key=unicodedata.combining):
            own = unicodedata.combining(m)
            free = not kept or own and own != unicodedata.combining(kept[-1])
            hit = MAPPING.get(out[-1] + m) if out and free else None
            if hit is not None and len(hit) == 1:
                out[-1] = hit
            elif own and out:
                kept.append(m)
            else:
                out, kept = [*out[:-1], "".join((*out[-1:], *kept)), m] if kept else [*out, m], []
    return "".join(out + kept)


_MEMO: dict[str, str] = {}


def transduce(text: str | None) -> str | None:
    """The consistent form of a text; null stays null and an empty text stays empty."""
    if not text or text.isascii() and not _TRIGGER.search(text) or not _TRIGGER.search(text):
        return text
    out: list[str] = []
    word: _Word | None = None
    lead = _LEADING.match(text)
    items = _CLUSTER.findall(text, lead.end() if lead else 0)
    for i, (base, ext) in enumerate(items):
        joiner = ""
        if base in _INVISIBLE:
            ext = "".join(c for c in ext if c not in _INVISIBLE)
            if not ext:
                continue
            base, ext = ext[0], ext[1:]
        if ext:
            if ZWJ in ext or ZWNJ in ext:
                after = items[i + 1][0] if i + 1 < len(items) else ""
                if after and (_ARABIC.match(base) and _ARABIC.match(after) or ZWJ in ext and _PICTURE.match(base) and _PICTURE.match(after)):
                    joiner = ZWJ if ZWJ in ext and not (ZWNJ in ext and ext.index(ZWNJ) < ext.index(ZWJ)) else ZWNJ
            ext = "".join(c for c in ext if c not in _INVISIBLE)
        cluster = base + ext
        got = _MEMO.get(cluster)
        if got is None:
            if len(_MEMO) > 200_000:
                _MEMO.clear()
            got = _MEMO[cluster] = _map_cluster(cluster)
        if got and got[0].isalpha() and _SCRIPT[got[0]] not in ("", "M"):
            word = word or _Word()
            for letter in got:
                word.add(letter, _SCRIPT[letter] or "M")
        else:
            if word:
                out.extend(word.written())
                word = None
            out.append(got)
        if joiner:
            out.append(joiner)
    if word:
        out.extend(word.written())
    done = "".join(out)
    if not _ANY_LOOK.isdisjoint(done):
        done = _KATA_RUN.sub(lambda m: "".join(IDEOGRAPH_AS_KATAKANA.get(c) or KATAKANA_AS_IDEOGRAPH[c] for c in m.group()), done)
    return done


def inconsistent(text: str | None) -> bool:
    """Whether a text is not in the consistent form."""
    return bool(text) and transduce(text) != text
