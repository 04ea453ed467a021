"""Template residue and error-page text: a multi-pattern automaton over whole texts.

One automaton holds the phrases of error pages, script demands, browser checks and filler
in six languages, and the stand-ins that editors and programs leave.  A text is an error
or filler text if the phrases cover most of it; an unfilled place or a stand-in counts
wherever it stands, save in code.  Nothing here needs Spark.
"""

from __future__ import annotations

import re
from http import HTTPStatus
from itertools import product

import ahocorasick

# --- fixed values -------------------------------------------------------------------
ERROR_PHRASES = (
    "404 not found", "error 1020", "error 404", "error 403", "error 500", "error 502", "error 503", "error 410", "error 429", "page not found", "not found",
    "we can't find that page", "we can’t find that page", "oops, nothing here", "something went wrong", "internal server error",
    "bad gateway", "gateway timeout", "service unavailable", "forbidden", "access denied", "unauthorized", "gone", "too many requests",
    "session expired", "down for maintenance", "this account has been suspended", "error establishing a database connection",
    "this page has moved or no longer exists", "the address you requested does not exist on", "the link may be out of date",
    "check the spelling or return to the home page", "our engineers have been told about it", "please try again in", "please try again later", "minutes",
    "you do not have permission to view this resource", "if the trouble persists, contact the webmaster of", "took too long to answer",
    "the server at", "request id:", "reference", "node", "was not found on this server",
    "seite nicht gefunden", "zugriff verweigert", "kennung", "dieser dienst ist vorübergehend nicht erreichbar", "interner serverfehler",
    "page introuvable", "accès refusé", "référence", "service momentanément indisponible", "erreur interne du serveur",
    "página não encontrada", "acesso negado", "serviço temporariamente indisponível", "erro interno do servidor",
    "страница не найдена", "доступ запрещён", "доступ запрещен", "код", "сервис временно недоступен", "внутренняя ошибка сервера",
    "お探しのページは見つかりませんでした", "指定された記事は削除されたか、urlが変更されています", "このページを表示する権限がありません", "ページが見つかりません",
    "アクセスが集中しています", "しばらくしてから再度お試しください", "エラーが発生しました", "番号", "セッションの有効期限が切れました", "ただいまメンテナンス中です",
)
SCRIPT_PHRASES = (
    "you need to enable javascript to run this app", "please turn on javascript to view", "javascript is disabled in your browser", "please enable javascript",
    "this site requires scripts and cookies", "enable them and reload", "if nothing appears, allow scripts for", "loading…", "loading...",
    "this content is rendered on the client", "your browser is not supported", "please upgrade to continue", "checking your browser before opening",
    "verify that you are human to continue", "one more step: complete the security check for", "noscript:",
    "bitte aktivieren sie javascript, um", "zu nutzen", "veuillez activer javascript pour afficher", "ative o javascript para continuar em",
    "включите javascript, чтобы открыть", "javascriptを有効にしてからご覧ください", "ご利用のブラウザではスクリプトが無効になっています",
)
# What error pages say of what, by language: every subject goes with every statement.
ERROR_SAYINGS = (
    ("the page|this page|page|the requested page|the requested url|this url|the file|the document|this link|this article|this content|the content|the resource|the requested resource|that page|the page you are looking for|the page you requested|the page you were looking for",
     "not found|was not found|could not be found|cannot be found|can't be found|can’t be found|does not exist|doesn't exist|doesn’t exist|no longer exists|is no longer available|is not available|isn't available|isn’t available|has been removed|has been deleted|may have been moved|might have been removed|has expired|is unavailable"),
    ("die seite|diese seite|seite|die angeforderte seite|die gewünschte seite|dieser inhalt|dieser artikel|die url", "nicht gefunden|wurde nicht gefunden|konnte nicht gefunden werden|existiert nicht|existiert nicht mehr|ist nicht verfügbar|ist nicht mehr verfügbar|wurde gelöscht|wurde verschoben"),
    ("la page|cette page|page|la page demandée|la page que vous recherchez|ce contenu|cet article", "introuvable|est introuvable|n'existe pas|n’existe pas|n'existe plus|n’existe plus|n'a pas été trouvée|n’a pas été trouvée|n'est plus disponible|n’est plus disponible|a été supprimée|non trouvée"),
    ("a página|esta página|página|a página solicitada|a página que você procura|este conteúdo|este artigo", "não encontrada|não foi encontrada|não existe|não existe mais|não está disponível|não está mais disponível|foi removida|foi excluída"),
    ("страница|эта страница|запрошенная страница|запрашиваемая страница|статья|материал", "не найдена|не найден|не существует|больше не существует|недоступна|недоступен|удалена|удален|была удалена"),
)
JAPANESE_SAYINGS = ("ページが|ページは|記事が|記事は|ファイルが|コンテンツは", "見つかりません|見つかりませんでした|存在しません|削除されました|削除されています|利用できません|表示できません")
# What pages ask for before they show anything: every verb goes with every object.
SCRIPT_SAYINGS = (
    ("enable|turn on|activate|allow|switch on|requires|needs|without", "javascript|javascript and cookies|cookies and javascript|scripts|scripts and cookies|cookies"),
    ("aktivieren sie|aktiviere|bitte aktivieren sie|benötigt|erfordert", "javascript|javascript und cookies|cookies"), ("activez|activer|veuillez activer|nécessite", "javascript|javascript et les cookies|les cookies"),
    ("ative|habilite|ativar|habilitar|requer", "javascript|o javascript|javascript e cookies|os cookies"), ("включите|разрешите|требуется", "javascript|cookie|javascript и cookie"),
    ("javascript", "is disabled|is not enabled|is required|must be enabled|ist deaktiviert|est désactivé|está desativado|отключен|が無効です|を有効にしてください|が必要です"),
)
BROWSER_CHECKS = (
    "just a moment", "checking your browser", "checking if the site connection is secure", "verifying you are human", "verify you are human", "verify that you are human", "are you a robot", "i'm not a robot", "attention required", "ddos protection by", "performance & security by cloudflare",
    "unusual traffic from your computer network", "complete the security check", "complete the captcha", "needs to review the security of your connection", "please wait while we verify", "your browser will redirect", "einen moment bitte", "ich bin kein roboter", "un instant", "um momento", "подождите", "проверка браузера", "しばらくお待ちください",
)
# Words around the above that cover a text, but alone prove nothing.
CONNECTING = (
    "the requested url", "please", "before proceeding", "before accessing", "please wait", "to continue", "to view this page", "to view this site", "to use this site", "to run this app", "in your browser", "in your browser settings", "and reload", "and reload the page", "and try again", "this page", "this site", "this website", "the site", "you need to", "you must", "sorry", "oops", "we are sorry", "we're sorry", "error", "http status", "http error", "status", "type status report", "message",
    "go back", "return to the home page", "go to homepage", "home page", "try searching", "contact us", "cloudflare", "ray id", "your ip", "cookies", "back to home", "the server", "on this server", "bitte", "zurück zur startseite", "es tut uns leid", "désolé", "retour à l'accueil", "retour à l’accueil", "por favor", "desculpe", "voltar ao início", "извините", "на главную", "пожалуйста", "申し訳ありません", "申し訳ございません", "トップページへ戻る", "お探しの", "指定された",
)
#: Phrases above that are common words: they cover a text, but alone prove nothing.
WEAK_PHRASES = frozenset((
    "reference", "node", "minutes", "gone", "forbidden", "not found", "request id:", "kennung", "référence", "код", "番号", "the server at", "took too long to answer",
    "please try again in", "zu nutzen", "loading…", "loading...", "unauthorized", "noscript:", "this content is rendered on the client",
))
FILLER_PHRASES = (
    "仮の文章です", "配置の確認用です", "文字数を確かめています", "原稿が届くまでの埋め草です", "見本の段落です", "行間を見るための文です", "ここは後で差し替えます", "あいうえおかきくけこ",
    "ダミーテキスト", "サンプルテキスト", "blindtext", "platzhaltertext", "faux texte", "texto de preenchimento", "текст-рыба",
)
FILLER_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
STAND_INS = (
    "[object object]", "hello undefined", "welcome to undefined", "by undefined", "nan minutes read", "read by null", "xxx text to come xxx", "text to come",
    "tbd - replace with final copy", "todo: write the intro before publishing", "title goes here", "click here to edit this text", "enter your subtitle here",
    "hier überschrift eingeben", "ここに見出しを入力してください", "（本文をここに入れる）", "insert text here", "your text here", "add your text here", "text hier eingeben",
    "saisissez votre texte ici", "insira seu texto aqui", "введите текст здесь", "dear undefined", "dear null", "hello null",
)


def _statuses() -> list[str]:
    """The ways in which servers write their error codes with the names of the standard."""
    out = []
    for st in HTTPStatus:
        if st >= 400:
            name = st.phrase.lower()
            out += [f"{st.value} {name}", f"{st.value} - {name}", f"{st.value} – {name}", f"{st.value}: {name}", f"error {st.value}", f"{st.value} error", f"http {st.value}", f"http status {st.value}", f"http error {st.value}", f"fehler {st.value}", f"erreur {st.value}", f"erro {st.value}", f"ошибка {st.value}", f"エラー{st.value}", f"{st.value}エラー"]
    return out


def _sayings(pairs) -> list[str]:
    return [f"{a} {b}" for subjects, said in pairs for a, b in product(subjects.split("|"), said.split("|"))]


def phrases() -> list[tuple[str, str, bool]]:
    """Kind, phrase and whether it is weak, of all phrases that cover error, script and filler texts."""
    japanese = ["".join(x) for x in product(*(p.split("|") for p in JAPANESE_SAYINGS))]
    out = [("error", w, w in WEAK_PHRASES) for w in (*ERROR_PHRASES, *_statuses(), *_sayings(ERROR_SAYINGS), *japanese)]
    out += [("script", w, w in WEAK_PHRASES) for w in (*SCRIPT_PHRASES, *_sayings(SCRIPT_SAYINGS), *(x.replace("javascript ", "javascript") for x in _sayings(SCRIPT_SAYINGS[-1:])), *BROWSER_CHECKS)]
    out += [("filler", w, w in WEAK_PHRASES) for w in FILLER_PHRASES]
    known = {w for _, w, _ in out}
    return out + [("connecting", w, True) for w in CONNECTING if w not in known]


#: What the collector itself writes before the words of a page.
REPORT_PREFIX = re.compile(
    r"^(?:low-confidence extraction:|upstream:|no extractable text found; browser fallback failed:|HTTP \d{3}(?:; page says:| -)|noscript:)\s*"
)
#: Reports of the collector, which repeat no page.
REPORT = re.compile(
    r"(?:\[Errno -?\d+\].*|document exceeds \d+ byte safety limit|(?:low-confidence extraction: )?\d+ characters(?:; browser fallback failed: page closed)?|blocked URL: .*"
    r"|HTTP(?: status| error)?:? \d{3}|(?:HTML )?(?:download|response|body|document) (?:truncated|too large|exceeds) .*|(?:request|read|connect(?:ion)?)? ?(?:timed out|timeout)(?: after .*)?|connection (?:refused|reset|aborted|closed).*|(?:SSL|TLS)[ :].*|(?:DNS|name resolution|could not resolve|name or service not known).*|unsupported content type: \S+|timed out|Remote end closed connection.*|certificate verify failed: .*|Timeout \d+ms exceeded)"
)
#: Share of a text that phrases must cover for it to be an error or filler text.
MIN_COVERAGE = 0.5

# --- unfilled places --------------------------------------------------------------
# what stands between signs that prose does not have may be anything on one line; between others, a name
_ANY = r"(?:[^\n{}]|\{[^\n{}]*\})+"
_F = r"[A-Za-z_][\w.-]{2,40}(?: ?\| ?\w{1,20}| \w{1,20}){0,3}"
PLACEHOLDER = re.compile(
    rf"(?<![\\^])\{{\{{\{{(?!\s*\}}){_ANY}\}}\}}\}}|(?<![\\^])\{{\{{(?!\s*\}}){_ANY}\}}\}}|\{{%(?![\s-]*%\}})(?:(?!%\}})[^\n])+%\}}|\$\{{(?!\s*\}}){_ANY}\}}|#\{{{_F}\}}|\{{\${_F}\}}|(?<![\\\w^_}}$]){{{_F}}}"
    rf"|<%(?![\s=-]*%>)(?:(?!%>)[^\n])+%>|<<{_F}>>|%\({_F}\)[sd]|%%{_F}%%|@@{_F}@@|&&{_F}&&|\*\|{_F}\|\*|\[#{_F}#\]|\[%{_F}%\]"
    rf"|\[Your {_F}\]|\[INSERT {_F} HERE\]|(?<![\w$])\${_F}\$(?![\w$])|__{_F}__(?=\s|$)|(?<![\w%])%[ds](?![\w%])"
)
_SIGNS = re.compile(r"[{}<$%@&\[*_]")
_FENCED = re.compile(r"^ *(```|~~~).*?(?:^ *\1|\Z)", re.S | re.M)
_INLINE = re.compile(r"(`+)(?!`)(?:(?!\n[ \t]*\n).)+?(?<!`)\1(?!`)", re.S)
_MATH = re.compile(r"\$\$.+?\$\$|\\\(.+?\\\)|\\\[.+?\\\]|\\[A-Za-z]+(?:\{[^\n{}]*\})*\{\{[^\n{}]*\}\}", re.S)
_ESCAPES = re.compile(r"%[0-9A-Fa-f]{2}")
_NEUTRAL = re.compile(
    r"(?<!\S)/[\w./?&=%-]+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|test|com|org|net)\b|\b(?=[0-9a-f]*\d)[0-9a-f]{5,}\b|\d+|[^\w]+", re.I
)


def _build() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, w, weak in reversed(phrases()):  # the first of equal ones stays
        a.add_word(w, (kind, len(w), weak))
    for w in STAND_INS:
        a.add_word(w, ("stand-in", len(w), False))
    for w in set(FILLER_WORDS):
        if len(w) > 3 and w not in a:  # the short ones are words of living languages, too
            a.add_word(w, ("lorem", len(w), True))
    a.make_automaton()
    return a


_AUTOMATON = None


def _automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _build()
    return _AUTOMATON


def without_code(text: str) -> str:
    """A text without fenced and quoted code, mathematics and percent-escapes."""
    if "```" in text or "~~~" in text:
        text = _FENCED.sub(" ", text)
    if "`" in text:
        text = _INLINE.sub(" ", text)
    if "\\" in text or "$$" in text:
        text = _MATH.sub(" ", text)
    return _ESCAPES.sub(" ", text) if "%" in text else text


def scan(text: str) -> dict:
    """Coverage of a text by phrases, and what it holds of each kind.

    ``share`` is the part of the words that error, script and filler phrases cover, hosts,
    numbers and ids aside; ``strong`` whether one of them proves such a page.
    """
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    covered = bytearray(len(low))
    strong, stand_in, lorem, kinds = False, False, 0, {}
    for end, (kind, n, weak) in _automaton().iter(low):
        start = end - n + 1
        if kind == "stand-in":
            stand_in = True
            continue
        if low[start].isascii() and low[start].isalnum() or kind == "lorem":
            before = low[start - 1] if start else " "
            after = low[end + 1] if end + 1 < len(low) else " "
            if before.isalnum() or after.isalnum() and low[end].isalnum():
                continue
        covered[start : end + 1] = b"\1" * n
        kind_of = "filler" if kind == "lorem" else kind
        if kind != "connecting":
            kinds[kind_of] = kinds.get(kind_of, 0) + n
        lorem += kind == "lorem"
        strong = strong or not weak
    if not kinds:
        return {"share": 0.0, "strong": False, "stand_in": stand_in, "kinds": kinds}
    words = covered_words = 0
    spans = []
    at = 0
    for m in _NEUTRAL.finditer(low):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(low)))
    for a, b in spans:
        words += b - a
        covered_words += sum(covered[a:b])
    share = covered_words / words if words else 0.0
    return {"share": share, "strong": strong or lorem >= 5, "stand_in": stand_in, "kinds": kinds}


def unfilled(text: str) -> list[str]:
    """The unfilled places of a text, code aside."""
    if not _SIGNS.search(text):
        return []
    return PLACEHOLDER.findall(without_code(text))


def classify(text: str | None) -> str | None:
    """``error``, ``script``, ``filler``, ``template``, ``placeholder``, ``stand-in`` or None.

    The first four say that the whole text is such a thing, the other two that it holds one
    somewhere.  A null, empty or blank text is none of them.
    """
    if not text or not text.strip():
        return None
    places = unfilled(text)
    bare = without_code(text)
    if places:
        rest = PLACEHOLDER.sub(" ", bare)
        left = len("".join(w for w in re.findall(r"\w+", rest) if w.lower() not in ("by", "posted", "dear", "hello", "filed", "under")))
        if left < 0.5 * sum(map(len, places)):
            return "template"
    seen = scan(bare)
    if seen["share"] >= MIN_COVERAGE and (seen["strong"] or seen["share"] >= 0.8 and len(bare) < 200):
        return max(seen["kinds"], key=seen["kinds"].get)
    if places:
        return "placeholder"
    return "stand-in" if seen["stand_in"] else None


def classify_report(text: str | None) -> str | None:
    """The same for a warning or an error of the collector, whose own reports are none."""
    if not text or not text.strip():
        return None
    if unfilled(text):
        return "placeholder"
    said = REPORT_PREFIX.sub("", text.strip())
    if REPORT.fullmatch(text.strip()) or REPORT.fullmatch(said):
        return None
    kind = classify(said)
    if kind is None and text.lower().startswith("noscript:"):
        return "script"
    return kind
