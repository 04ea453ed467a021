"""Residue by kind, and what only looks like it."""

import pytest

from lodestack.llm import residue, residue_filter

ARTICLE = "The valve was replaced over the winter, and nobody at Hallam minded. It took nine days more than planned."
SHAPES = "{{ title }}|{{{title}}}|{% title %}|{title}|{$title}|${title}|$title$|#{title}|<%= title %>|<<title>>|%(title)s|%%title%%|@@title@@|&&title&&|*|title|*|[#title#]|[%title%]|[Your title]|[INSERT title HERE]|{{ user.email }}|{{ category | lower }}|{include header}".replace("*|title|*", "*\x00title\x00*").replace("y | l", "y \x00 l")


@pytest.mark.parametrize("shape", [s.replace("\x00", "|") for s in SHAPES.split("|")])
def test_unfilled_places(shape):
    assert residue.classify(f"{ARTICLE} By {shape}, they said.") == "placeholder"
    assert residue.classify(f"# {shape}\nBy {shape}") == "template"
    assert residue.classify(f"{ARTICLE} Write `{shape}` there.") is None
    assert residue.classify(f"{ARTICLE}\n\n```\n{shape}\n```\n") is None


@pytest.mark.parametrize("text", ["404 Not Found\nThe link may be out of date.", "PAGE NOT FOUND", "Zugriff verweigert (Kennung b0daf0f9ec0)", "お探しのページは見つかりませんでした", "## Something went wrong\nRequest id: 33647feab00c", "Error 1020\nReference bc14d446fc0f, node 70"])
def test_error_pages(text):
    assert residue.classify(text) == "error"


@pytest.mark.parametrize("text", ["You need to enable JavaScript to run this app.", "Включите JavaScript, чтобы открыть www.a.example.", "Checking your browser before opening a.example...", "JavaScriptを有効にしてからご覧ください。"])
def test_script_demands(text):
    assert residue.classify(text) == "script"


def test_filler_and_stand_ins():
    assert residue.classify("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor. " * 400) == "filler"
    assert residue.classify("仮の文章です3。文字数を確かめています。見本の段落です。") == "filler"
    for s in ("Hello undefined, welcome to undefined.", "[object Object]", "TODO: write the intro before publishing", "ここに見出しを入力してください"):
        assert residue.classify(f"{s}\n\n{ARTICLE}") == "stand-in"


@pytest.mark.parametrize(
    "text",
    [ARTICLE, "The phrase “page not found” appears on every faded template that Skeomum delayed.", "Typesetters still fill a theatre with lorem ipsum, and nobody reads it.", "A 503 is politer than a 500, says Thufex.", "Let S be the set {1, 2, 5} that they moved.", "See https://a.example/a%0B7D?x=%2y for more.", "In \\(f_{index}\\) and $$x_{max}$$ all holds.", "Com R$ 1162, e R$ 36 depois.", "", None, "  \n"],
)
def test_no_residue(text):
    assert residue.classify(text) is None


@pytest.mark.parametrize("text", ["timed out", "HTTP 404", "[Errno -2] Name or service not known", "unsupported content type: image/png", "blocked URL: https://a.example/a%0B7D?x=%4y", "low-confidence extraction: 44 characters", "certificate verify failed: self-signed certificate for a.example", "no extractable text found; browser fallback failed: Timeout 30000ms exceeded", "document exceeds 99 byte safety limit", "", None])
def test_own_reports(text):
    assert residue.classify_report(text) is None


@pytest.mark.parametrize("text", ["%s: timed out", "HTTP {code}", "low-confidence extraction: %d characters", "fetch of <%= url %> failed", "document exceeds %(limit)s byte safety limit", "upstream: Page introuvable", "HTTP 403; page says: Error 1020 Request id: 3f8ca1be6645", "low-confidence extraction: Verify that you are human to continue.", "noscript: this content is rendered on the client"])
def test_reports_of_pages(text):
    assert residue.classify_report(text)


def test_found(spark, archive):
    d = archive(
        resource_revision=[{"resource_revision_id": "a", "content_markdown": "Page not found"}, {"resource_revision_id": "a", "content_markdown": "Page not found"}, {"resource_revision_id": "b", "content_markdown": ARTICLE}, {"resource_revision_id": "c", "content_markdown": None}],
        fetch_capture=[{"fetch_capture_id": "d", "warning": "HTTP {code}"}, {"fetch_capture_id": "e", "warning": "timed out"}, {"fetch_capture_id": "f", "warning": ""}],
        page_fetch=[{"page_fetch_id": "g", "error": "Gone The link may be out of date."}, {"page_fetch_id": "h", "error": None}],
    )
    assert sorted(map(tuple, residue_filter.p6_found(spark, d).collect())) == [("fetch_capture", "d"), ("page_fetch", "g"), ("resource_revision", "a")]
    assert {tuple(r) for r in residue_filter.p6_kinds(spark, d).collect()} == {("resource_revision", "a", "error"), ("fetch_capture", "d", "placeholder"), ("page_fetch", "g", "error")}
    assert residue_filter.p6_found(spark, archive()).count() == 0


@pytest.mark.parametrize("shape", ["{{id}}", "{{x}}", "${id}", "{% if user %}", "{{#if user}}", "{{> header}}", "{{ name | default: 'x' }}", "{{user.tags[0]}}", "{{名前}}", "{{имя}}", "<%= x %>", "{{ f({a: 1}) }}", "{{" + "a" * 60 + "}}"])
def test_unfilled_places_of_any_content(shape):
    assert residue.classify(f"{ARTICLE} By {shape}, they said.") == "placeholder"
    assert residue.classify(f"{ARTICLE} Write `{shape}` there.") is None
    assert residue.classify(f"A stray ` here.\n\n{ARTICLE} By {shape}.\n\nAnother ` there.") == "placeholder"


@pytest.mark.parametrize("text", ["{{ }}", "{%%}", "${}", "<% %>", "{{1, 2}, {3}}", "\\frac{{a}}{b}", "x^{{2}}"])
def test_empty_or_mathematical_braces(text):
    assert residue.classify(f"{ARTICLE} So {text} is.") is None


# ordinary pages of servers and sites, none of them from the archive
ELSEWHERE = [
    ("Enable JavaScript and cookies to continue", "script"), ("Just a moment...", "script"), ("Attention Required! | Cloudflare", "script"), ("Checking your browser before accessing example.com. Please wait...", "script"), ("Verify you are human", "script"),
    ("JavaScript is disabled in your browser. Please enable JavaScript to continue.", "script"), ("Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen", "script"), ("HTTP Status 404 – Not Found", "error"), ("403 Forbidden\nnginx/1.18.0", "error"), ("502 Bad Gateway", "error"),
    ("Diese Seite existiert nicht mehr.", "error"), ("Cette page n’existe pas", "error"), ("Esta página não existe mais", "error"), ("Запрашиваемая страница не найдена", "error"), ("申し訳ありません。お探しのページは存在しません", "error"), ("Sorry, this page isn't available.", "error"),
    ("The requested URL /foo/bar.html was not found on this server.", "error"), ("Oops! That page can’t be found.", "error"), ("Page not found\nThe page you are looking for does not exist.", "error"),
]
SOUND_ELSEWHERE = [
    "When a page could not be found, servers answer with an error. The history of that number is long and has little to do with a room at a laboratory.", "Please contact us", "This page", "Cloudflare", "Cookies are baked at 180 degrees",
    "How to enable JavaScript in Chrome: open the settings, then the page of privacy, and choose it there for all sites that you trust.", "Um momento de calma: a história do rio e da cidade",
]


@pytest.mark.parametrize("text, kind", ELSEWHERE)
def test_pages_from_elsewhere(text, kind):
    assert residue.classify(text) == kind


@pytest.mark.parametrize("text", SOUND_ELSEWHERE)
def test_sound_texts_from_elsewhere(text):
    assert residue.classify(text) is None


def test_reports_of_other_collectors():
    for text in ("HTTP 404", "HTTP error 503", "connection refused by host", "read timed out after 30 s", "SSL: CERTIFICATE_VERIFY_FAILED", "DNS lookup failed for example.com", "body too large: 12 MB"):
        assert residue.classify_report(text) is None, text
    assert residue.classify_report("HTTP 503 - Service unavailable") == "error"
