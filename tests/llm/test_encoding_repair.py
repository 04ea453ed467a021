"""Wrong decodings are undone; sound texts stay."""

import pytest

from lodestack.llm import encoding_repair, mojibake

SOUND = [
    "That didn’t stop the café from opening — “twice”, they said. It cost £40.", "Für rund 645 Euro wird die Brücke größtenteils übersetzt. „Ohne Maß“, sagt Ute.", "À l’étage, « la forêt » coûte 399 € et reste très chère.",
    "São 65 edições, e o órgão continua quase esquecido. A maçã e a região não.", "Каждый ночной рынок содержит 2451 записей, но маяк удвоили только за три недели.", "三階で見つけた隧道を釣り合わせた。この灯台には64件の温室が登録されている。",
    "The village of Ýr’s Þórsgarð and the isle of Ñanduá were counted.", "EDIÇÃO, MAÇÃ E NÃO: tudo em maiúsculas.", "« Ô RÂLEUR, Â MESURER », lit-on chez Kigia.", "A page that shows `Ã©` where é should be was decoded twice.", "plain ascii & more", "", None, " \n",
    "```\nx = 'Ã©'\n```",
]
#: Texts in languages that the archive does not have.
FOREIGN = [
    "Łódź jest piękna i żółta, a Gdańsk też.", "Příliš žluťoučký kůň úpěl ďábelské ódy", "Árvíztűrő tükörfúrógép", "Pijamalı hasta yağız şoföre çabucak güvendi", "Đorđe Žižek čeka ćevape", "ąžuolas ėjo į miškų ūkį", "Īsa ūdens ķēde šķērso ļaudis",
    "Kæmi ný öxi hér, ykist þjófum nú bæði víl og ádrepa", "Høj bly gom vandt fræk sexquiz på wc", "Flygande bäckasiner söka hwila på mjuka tuvor", "Ășțâî în România", "Tiếng Việt rất đẹp và người dân thân thiện.", "ŝĝĥ eĥoŝanĝo ĉiuĵaŭde", "İstanbul", "Çağrı", "Čapek", "Ő", "ÅÄÖ", "co·l·lecció l’àvia",
    "Η γρήγορη αλεπού πηδάει πάνω από το σκυλί.", "ΕΛΛΗΝΙΚΑ ΚΕΦΑΛΑΙΑ", "Ὁ πολλὰ", "Привіт, як справи? Її їжа є смачною, ґанок", "Добро јутро, како сте? Љубав и њива, ћуприја", "Здравей, как си? Ъгъл", "Сәлем, қалайсың? Өмір", "ПРИВЕТ МИР",
    "שלום עולם, מה שלומך היום?", "مرحبا بالعالم، كيف حالك اليوم؟", "สวัสดีชาวโลก", "नमस्ते दुनिया", "한국어 문장입니다. 오늘 날씨가 좋네요.", "今天天气很好，我们去公园散步吧。", "今天天氣很好，我們去公園散步吧。", "ｶﾀｶﾅ ﾃｷｽﾄ ﾃﾞｽ", "齟齬", "鰺ヶ沢", "🎉 Fête 🎊",
    "├── src", "│   └── main.py", "x² + y² = z², √2 ≈ 1.41", "gamma γ and π are used", "µm und Ω", "© 2024 – ½ price™",
]


@pytest.mark.parametrize("text", FOREIGN)
def test_sound_texts_of_other_languages_stay(text):
    assert mojibake.examine(text) == (False, text)


@pytest.mark.parametrize("text", [t for t in FOREIGN if len(t) > 20 and "ｶ" not in t and "½" not in t])
def test_other_languages_come_back(text):
    assert mojibake.examine(text.encode().decode("latin-1")) == (True, text)


def test_every_garbled_line_comes_from_the_search(monkeypatch):
    searched = []
    search = mojibake.search
    monkeypatch.setattr(mojibake, "search", lambda line, *a, **k: searched.append(line) or search(line, *a, **k))
    monkeypatch.setattr(mojibake, "_MEMO", {})
    lines = [SOUND[2].encode().decode("latin-1"), SOUND[4].encode("cp1251").decode("koi8-r"), SOUND[5].encode().decode("cp932", "replace"), "lost � here"]
    assert all(mojibake.examine(x)[0] for x in lines) and searched == lines
    assert mojibake.wrong_charset(SOUND[4].encode(), "koi8-r")[0] and len(searched) == len(lines) + 1


def test_lost_bytes_and_deep_nesting():
    bad = SOUND[5].encode().decode("cp932", "replace")
    garbled, text = mojibake.examine(bad)
    assert garbled and sum(c in SOUND[5] for c in text) > 0.8 * len(text)
    four = "Die Brücke für Jürgen ist größer."
    for _ in range(4):
        four = four.encode().decode("latin-1")
    assert mojibake.examine(four) == (True, "Die Brücke für Jürgen ist größer.")


def test_the_named_encoding_decides():
    bad = "où Θ est".replace("ù", "ù".encode("cp1252").decode("cp437")).replace("Θ", "é".encode("cp1252").decode("cp437"))
    assert mojibake.examine(bad, "ibm437") == (True, "où é est")
    assert mojibake.examine("gamma γ", "utf-8") == (False, "gamma γ") and mojibake.examine(SOUND[2], "no such") == (False, SOUND[2])


#: right and wrong encoding of each garbled text.
WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac-roman"), ("utf-8", "cp437"), ("utf-8", "cp850")]


@pytest.mark.parametrize("text", SOUND)
def test_sound_texts_stay(text):
    assert mojibake.examine(text) == (False, text)


@pytest.mark.parametrize("right, wrong", WRONG)
@pytest.mark.parametrize("text", SOUND[:6])
def test_utf8_read_otherwise_comes_back(text, right, wrong):
    try:
        bad = text.encode(right).decode(wrong)
    except UnicodeDecodeError:
        pytest.skip("not decodable")
    assert mojibake.examine(bad) == (True, text)


@pytest.mark.parametrize("text, right, wrong", [(SOUND[4], "cp1251", "cp1252"), (SOUND[4], "cp1251", "koi8-r"), (SOUND[4], "koi8-r", "cp1251"), (SOUND[5], "cp932", "latin-1"), (SOUND[5], "euc_jp", "latin-1")])
def test_legacy_encodings_come_back(text, right, wrong):
    assert mojibake.examine(text.encode(right).decode(wrong)) == (True, text)


def test_twice_in_part_and_references():
    assert mojibake.examine("dÃƒÂ©cidÃƒÂ©")[1] == "décidé" and mojibake.examine("dÃƒÂ©jÃƒÂ  vu")[0]
    part = SOUND[5] + "\n" + SOUND[2].encode().decode("latin-1")
    assert mojibake.examine(part) == (True, SOUND[5] + "\n" + SOUND[2])
    assert mojibake.examine("caf&eacute; &amp; th&eacute;")[1] == "café & thé"
    assert mojibake.examine("lost � here")[0]


def test_long_text():
    text = "\n".join([SOUND[0]] * 3000)
    assert mojibake.examine(text) == (False, text)


def test_charsets():
    jp = "担当の東川町さんは「雑誌を比べた」と話している。".encode("cp932")
    w = lambda raw, c: mojibake.wrong_charset(raw, c)[0]
    assert not w(jp, "x-sjis") and not w(jp, "Shift_JIS") and w(jp, "utf-8") and w(jp, "windows-1252") and w(jp, "euc-jp")
    assert not w(SOUND[1].encode("cp1252"), "iso-8859-1") and not w(SOUND[1].encode(), "UTF8") and w(SOUND[1].encode(), "windows-1252")
    assert not w(SOUND[4].encode("koi8-r"), "KOI8-R") and w(SOUND[4].encode("koi8-r"), "windows-1251") and w(SOUND[2].encode("mac-roman"), "windows-1252")
    assert not w(b"ascii", "utf-16") and not w(jp, "") and not w(jp, None) and not w(None, "utf-8") and w(jp, "no-such-charset")
    assert mojibake.wrong_charset(jp, "utf-8")[1].startswith("担当")


def test_found_and_restored(spark, archive):
    bad = SOUND[2].encode().decode("latin-1")
    d = archive(
        resource_revision=[{"resource_revision_id": "a", "content_markdown": bad}, {"resource_revision_id": "a", "content_markdown": bad}, {"resource_revision_id": "b", "content_markdown": SOUND[0]}, {"resource_revision_id": "c", "content_markdown": None}],
        page_fetch=[{"page_fetch_id": "d", "text": bad}, {"page_fetch_id": "e", "text": ""}],
        payload=[{"payload_id": "f", "content": SOUND[4].encode(), "charset": "windows-1251"}, {"payload_id": "g", "content": SOUND[4].encode(), "charset": "utf-8"}, {"payload_id": "h", "content": None, "charset": "utf-8"}],
    )
    assert sorted(map(tuple, encoding_repair.p5_found(spark, d).collect())) == [("page_fetch", "d"), ("payload", "f"), ("resource_revision", "a")]
    got = {r["record_id"]: r["restored"] for r in encoding_repair.p5_restored(spark, d).collect()}
    assert got == {"a": SOUND[2], "d": SOUND[2], "f": SOUND[4]}
    assert encoding_repair.p5_found(spark, archive()).count() == 0


def test_each_sign_of_a_wrong_encoding_is_seen():
    for odd in ("Ã©", "é“”", "aÉ", "яЯ", "В«", "‹a", "nít", "Tís", "éèê", "я€", "—Я", "éA", ".é", "aя", "яa", "丄", "弌丐", "›A", "a亜 ", "aα", "αa", " α ", "&amp;", "&#12;", "\\u00e9", "\x9f", "ﾟ"):
        assert not mojibake.calm(odd) and not mojibake.calm(f"so {odd}"), odd
    for sound in ("É", "aé", "Я я", "« В »", "nítr", "éè", "€ я", "— a", "aéA", ". é", "a я", "弌", "a亜ア", "αβγ", "& amp", "u00e9", "A—B", "亜亜"):
        assert mojibake.calm(sound), sound
