"""The style tree on small sites."""

import random

from lodestack.llm import furniture, main_content

NAV = "About us | Archive | Contact | Help"


def _article(i: int) -> str:
    r = random.Random(i)
    some = lambda n: " ".join("".join(r.choice("aeioklmnrst") for _ in range(6)) for _ in range(n))
    return f"The {some(9)}, and nobody minded.\n\nIt {some(12)}, said the report."


#: Lines of the pages that a tree has learnt from; nothing is known in advance.
LEARNT = (
    NAV, "Home / Topics", "We use cookies to improve your visit.", "Got it", "Reject", "Advertisement", "Most read", "© 2020 Zeolu Weekly. All rights reserved.", "Back to top", "Search", "Contact", "À propos", "Vidéos",
    "Terms of use", "Privacy", "## Related articles", "## Contact us today",
)


def _taught(lines=LEARNT) -> furniture.Tree:
    own, masked = zip(*(furniture.line_nodes(line) for line in lines))
    titles = {n & ~6 for ids in own for n in ids if n & 6 == 6}
    return furniture.Tree({n & ~6 for ids in own for n in ids} - titles | {n for ids in masked for n in ids})


def _lines(text: str, lines=LEARNT, own=()) -> list[int]:
    return furniture.furniture_lines(text, _taught(lines), frozenset(own), frozenset(own))


def test_parts_of_a_page():
    page = f"{NAV}\nHome / Topics / Zeolu\nWe use cookies to improve your visit.\nGot it Reject\n\n{_article(1)}\n\nAdvertisement\n\n## Heading\n\n- A list of the article, which ends with a stop.\n\nMost read\n1. Some title\n2. [Other title](/a/x)\n© 2020 Zeolu Weekly. All rights reserved.\nBack to top"
    lines = page.split("\n")
    got = {lines[i - 1] for i in _lines(page)}
    assert got == {NAV, "Home / Topics / Zeolu", "We use cookies to improve your visit.", "Got it Reject", "Advertisement", "Most read", "1. Some title", "2. [Other title](/a/x)", "© 2020 Zeolu Weekly. All rights reserved.", "Back to top"}


def test_nothing_is_known_in_advance():
    page = f"{NAV}\nHome / Topics\nWe use cookies to improve your visit.\n{_article(1)}\nMost read\n1. Some title\nBack to top"
    assert furniture.furniture_lines(page, furniture.Tree()) == []


def test_pages_without_article_have_no_cases():
    for page in (f"{NAV}\n404 Not Found\nThe link may be out of date.", NAV, f"{NAV}\n{{{{ title }}}}\nBy ${{author}}", "", None, "  \n ", f"{NAV}\nLorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"):
        assert _lines(page) == []


def test_code_quotes_and_headings_stay():
    page = f"{_article(2)}\n\n```\nHome\nSearch\n```\n\n> Help\n\n## Contact"
    assert _lines(page) == []


def test_garbled_furniture_is_known():
    page = f"{_article(3)}\n\nÃ€ propos Â· VidÃ©os"
    assert _lines(page) == [page.count("\n") + 1]


def test_learns_nodes_of_several_hosts_but_not_of_copies(spark, archive):
    copy = f"Unheard of line\n{_article(0)}"
    pages = [{"page_fetch_id": f"c{i}", "url": f"https://h{i % 9}.test/c{i}", "text": copy} for i in range(40)]
    pages += [{"page_fetch_id": f"p{i}", "url": f"https://h{i % 9}.test/p{i}", "text": f"Zum Warenkorb\n{_article(i)}"} for i in range(1, 40)]
    pages += [{"page_fetch_id": "null", "url": None, "text": None}, {"page_fetch_id": "empty", "url": "", "text": ""}, pages[-1]]
    d = archive(page_fetch=pages)
    got = {(r["record_id"], r["line_no"]) for r in main_content.p2_found(spark, d).collect()}
    assert got == {(f"p{i}", 1) for i in range(1, 40)}
    main = {r["record_id"]: r["main"] for r in main_content.p2_main(spark, d).collect()}
    assert main["p5"] == _article(5) and main["c0"] == copy


def test_empty_tables(spark, archive):
    assert main_content.p2_found(spark, archive()).count() == 0


def test_learns_furniture_of_one_host_whatever_the_rest(spark, archive):
    page = lambda i: f"Ofertas Zibu | Ludoteca Zibu | Tarjeta regalo\n{_article(i)}\nDistribuye Imprenta Zibu, Calle Sol"
    pages = [{"page_fetch_id": f"z{i}", "url": f"https://zibu.test/{i}", "text": page(i)} for i in range(8)]
    copies = [{"page_fetch_id": f"k{i}", "url": f"https://copy.test/{i}", "text": f"Such is the line\n{_article(99)}"} for i in range(8)]
    others = [{"page_fetch_id": f"o{i}", "url": f"https://h{i}.test/{i}", "text": f"Tarjeta regalo\n{_article(i + 200)}"} for i in range(3)]
    d = archive(page_fetch=pages + copies + others)
    got = {(r["record_id"], r["line_no"]) for r in main_content.p2_found(spark, d).collect()}
    assert got == {(f"z{i}", n) for i in range(8) for n in (1, 5)}


def test_links_of_an_article_stay():
    sources = "\n".join(f"- [Source {x}](https://{x}.test/p)" for x in "abc")
    page = f"{_article(4)}\n\n## Sources\n\n{sources}\n- A plain item\n\n[A paper](https://x.test/1)\n\n{_article(5)}"
    assert _lines(page) == []
    page = f"{_article(4)}\n\n[One more](/a/x)\n[And another](https://h.test/b)\n\n{_article(5)}"
    assert furniture.furniture_lines(page, furniture.Tree(()), host=furniture.host_hash("h.test")) == [5, 6]


def test_long_lines_headings_and_questions_are_judged():
    menu = " | ".join(["About us", "Archive", "Contact", "Help", "Most read", "Terms of use", "Privacy"] * 5)
    assert len(menu) > 240
    page = f"{menu}\n{_article(6)}\n\nMost read\n- Why is it so?\n- What a day!\n- The last one"
    assert _lines(page) == [1, 6, 7, 8, 9]
    # titles are learnt by their own host only
    title = furniture.line_nodes("## Related articles")[0]
    page = page.replace("\nMost read\n", "\n## Related articles\n")
    assert _lines(page) == [1] and _lines(page, own=title)[:2] == [1, 6]
    notice = "We of Zibu keep some of what you tell us. It is kept in a box. The box is ours. You may ask for the box. " * 2
    learnt = furniture.page_nodes(f"{notice}\n{_article(7)}")[1]
    both = set(learnt) & set(furniture.page_nodes(f"{notice}\n{_article(8)}")[1])
    assert _lines(f"{NAV}\n{notice}\n\n{_article(9)}", own=both) == [1, 2]


def test_entropy_within_a_host(spark, archive):
    # a menu on one page in six of one host of sixty pages; a line of two of its pages stays
    page = lambda i: (["Ofertas Zibu | Ludoteca Zibu"] if i % 6 == 0 else []) + [_article(i)] + (["Ocho tazas"] if i in (1, 2) else [])
    pages = [{"page_fetch_id": f"z{i}", "url": f"https://zibu.test/{i}", "text": "\n".join(page(i))} for i in range(60)]
    d = archive(page_fetch=pages)
    got = {(r["record_id"], r["line_no"]) for r in main_content.p2_found(spark, d).collect()}
    assert got == {(f"z{i}", 1) for i in range(0, 60, 6)}
    texts = main_content.pages(spark, d)
    nodes, hosts = main_content.learn(spark, d)
    joined = main_content.judged(texts, nodes, hosts, most_held=0).where("size(lines) > 0")  # the same when the nodes of hosts are joined
    assert {(r["record_id"], n) for r in joined.collect() for n in r["lines"]} == got


def test_copies_with_small_edits_teach_nothing(spark, archive):
    words = _article(0).split(" ")
    edited = lambda i: " ".join([*words[:5], f"x{i}", *words[6:]])
    rest = "\n".join(f"A line of the page that holds more than sixty characters, number {n} of all of them" for n in range(12))
    pages = [{"page_fetch_id": f"c{i}", "url": "https://one.test/", "text": f"Unheard of line\n{edited(i)}\n{rest}"} for i in range(40)]
    pages += [{"page_fetch_id": f"p{i}", "url": "https://one.test/", "text": _article(i)} for i in range(1, 40)]
    assert main_content.p2_found(spark, archive(page_fetch=pages)).count() == 0


def test_every_line_is_read_once(monkeypatch):
    tree, own = _taught(), frozenset(furniture.line_nodes("Ludoteca Zibu")[0])
    page = f"{NAV}\n{_article(11)}\nСтрока только этой страницы"
    read = []
    quick = furniture.quick
    monkeypatch.setattr(furniture, "quick", lambda line: read.append(line) or quick(line))
    assert furniture.furniture_lines(page, tree, own, own) == [1]
    assert read == [line for line in page.split("\n") if line]


def test_segments_split_alike_from_blanks_on():
    r = random.Random(1)
    for _ in range(5000):
        body = "".join(r.choice([" ", "\t", "　", "|", "·", ">", "/", ".", "!", "?", "a", "B"]) for _ in range(r.randint(0, 12)))
        assert furniture._SPLIT_BLANKS.split(body) == furniture._SPLIT.split(body), body
