"""What counts as template residue, filler, an error page or a notice that scripts are needed.

A rule looks at decoded text (JSON strings unescaped). Placeholders are told by their punctuation;
error pages, notices and filler by how such texts are built, from classes of words (what fails and
how, what is to be enabled, what stands in for content), not by whole sentences. ``Judge`` says
which kind of residue a text holds and whether it is nothing but residue; only such texts are
trusted to label others. What makes a placeholder is its punctuation, which near-duplicates on
words do not see, so a placeholder alone is not trusted either.
"""

from __future__ import annotations

import re

from assayer.llm.canonical import WORD

#: A phrase is told of, not shown, if one of these follows it; "in 12" and the like are codes, as in IN-12.
_ALONE = r"(?! (?:by|to|for|from|in|with|on|at|like|of|the) (?!\d|[a-z]*\d))(?= )"
_SCRIPT = "(?:java ?script|ecmascript|js|scripts?|cookies)"
_PAGE = "(?:page|site|website|link|url|file|address|document|resource)"

#: Forms over words, each begun by a space. The reasons are those of HTTP.
_FORMS = [
    ("script_notice", [
        rf"(?:enable|activate|allow|unblock|(?:turn|switch) on) (?:\w+ ){{0,2}}?{_SCRIPT}",
        rf"{_SCRIPT} (?:is|are|must be|has to be|have to be|needs? to be|seems? to be|ist|sind|muss) (?:\w+ ){{0,2}}?(?:enabled|disabled|required|needed|blocked|on|off|deaktiviert|aktiviert|blockiert|erforderlich|nötig)",
        rf"(?:requires?|needs?|without|benötigt|braucht|erfordert|ohne) {_SCRIPT}",
        rf"{_SCRIPT} (?:turned|switched) off",
        rf"(?:aktivieren|erlauben) sie (?:\w+ )?{_SCRIPT}",
        r"(?:checking|verifying) your browser",
        r"(?:disable|deactivate|turn off) (?:\w+ ){0,2}?ad ?blockers?",
        r"[一-鿿]*(?:启用|开启|打开|允许) ?(?:javascript|js|脚本)",
        r"(?:javascript|js|脚本) ?(?:已|被|未)(?:禁用|启用|关闭|阻止)",
    ]),
    ("error_page", [
        r"(?:400 bad request|401 unauthorized|402 payment required|403 forbidden|404 (?:page )?not found|405 method not allowed|406 not acceptable|408 request time ?out|409 conflict|410 gone|413 payload too large|414 uri too long|415 unsupported media type|422 unprocessable (?:content|entity)|429 too many requests|451 unavailable for legal reasons|500 internal server error|501 not implemented|502 bad gateway|503 service unavailable|504 gateway time ?out|505 http version not supported)",
        r"(?:internal server error|bad gateway|gateway time ?out)",
        rf"(?:{_PAGE}|service) (?:not found|not available|temporarily unavailable)" + _ALONE,
        r"access (?:denied|forbidden|blocked)" + _ALONE,
        rf"{_PAGE} (?:that )?you (?:\w+ ){{1,6}}?(?:does not|doesn t|no longer|could not|couldn t|cannot|can t|was not|has been|is not|has moved)",
        rf"{_PAGE} (?:is|seems|appears to be|may be) (?:broken|dead|gone|missing)" + _ALONE,
        r"(?:seite|datei|adresse) (?:\w+ ){0,3}?(?:nicht (?:gefunden|erreichbar|verfügbar)|existiert nicht)",
        r"[一-鿿]*(?:页面|网页|链接|文件)(?:不存在|未找到|找不到|无法显示|已失效)",
        r"too many (?:requests|redirects|connections|attempts)" + _ALONE,
        r"something went wrong" + _ALONE,
        r"(?:an )?(?:unexpected|unknown|internal) error (?:has )?occurred",
        r"(?:session|login|token) (?:has |is )?(?:expired|timed out)(?= (?:please|sign|log|ref|[a-z]+ \d)| $)",
        r"(?:connection|request|operation|query) (?:has )?timed out" + _ALONE,
        r"(?:database|server|network|proxy) (?:connection|error) (?:failed|refused|lost|reset|closed|establishing)" + _ALONE,
        r"(?:fatal|parse|syntax|runtime|uncaught|unhandled) (?:error|exception)" + _ALONE,
        r"(?:down|offline|closed|unavailable) for (?:\w+ )?maintenance",
        r"traceback most recent call last",
    ]),
    ("filler", [
        r"lorem ipsum",
        r"(?:placeholder|dummy|filler|blind) ?(?:text|content|copy)(?! (?:of|in|by|was|were) (?!\d))",
        r"(?:sample|example|your|some|more) (?:text|content|copy|title|description|message)(?: goes| will appear| will go)? here",
        r"(?:description|content|text|details|information|image|title) (?:coming soon|to follow|to come|to be added)" + _ALONE,
        r"(?:type|enter|write) (?:something|anything)" + _ALONE,
        r"[一-鿿]*(?:示例|占位|测试|样本)(?:文字|文本|内容)",
        r"(?P<sign>[xyz])(?P=sign){2,}(?: (?P=sign){3,})+",
    ]),
]

# Words of the usual Latin filler.
LATIN = frozenset(
    """
    lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et
    dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea
    commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla
    pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim
    id est laborum
    """.split()
) - {"in", "do", "id", "ad", "ex", "non", "sit", "et", "est", "sed", "ut", "ea", "eu"}  # words of living languages too
#: Filler is a stretch of LATIN_SPAN words of which LATIN_HELD or more are such words.
LATIN_SPAN, LATIN_HELD = 10, 5

# What unfilled templates hold.
_NAME = r"[A-Za-z_][\w.]*"
_SIMPLE = "name|names|date|product|city|company|desk|address|email|phone|title|amount|reason|subject|customer|client|field|value|text|insert|placeholder|variable|todo|tbd|key"
_LOOKS_NAMED = rf"(?!(?i:sic|angle|nbsp)\b)(?:(?i:{_SIMPLE})\b|[A-Z][A-Z_ ]*[A-Z]|[A-Za-z]\w*[_.]\w+|[A-Za-z]+\d+)"
_OWNERS = "your|client|customer|company|first|last|full|recipient|sender|contact|product|project|user"
_PLACEHOLDERS = [
    rf"[\[<{{](?i:(?:(?:{_OWNERS}) ){{1,2}}(?:{_SIMPLE}))[\]>}}]",
    rf"\{{\{{\s*{_NAME}\s*\}}\}}",
    rf"\{{%\s*{_NAME}\s*%\}}",
    rf"<<\s*{_NAME}\s*>>",
    rf"\[\[\s*{_NAME}\s*\]\]",
    rf"@@{_NAME}@@",
    rf"[#$]\{{\s*{_NAME}\s*\}}",
    rf"\{{{_LOOKS_NAMED}\}}",
    rf"<{_LOOKS_NAMED}>",
    rf"\[{_LOOKS_NAMED}\]",
    rf"%{_LOOKS_NAMED}%",
    rf"\${_NAME}\$",
    r"\{\d\}",
    r"(?<![\w%])%[sd](?!\w)",
    r"<\|\w+\|>",
    r"_{4,}",
    r"\.{6,}",
    r"【[^】]*填[^】]*】",
    r"\[object Object\]",
    r"[\[<(](?i:insert|add|replace|enter|write|your)\b[^\]>)]*[\]>)]",
    r"\[[^\]]*(?:einfügen|eintragen|ausfüllen)\]",
    r"\(name\)",
    r"\b(?:INSERT|YOUR|ENTER)_[A-Z]+\b",
    r"\b[A-Z]{3,}_NAME\b",
    r"\b(?:TODO|FIXME)\b:?(?:\s+(?:write|wording|add|fill)\b(?:\s+\w+){0,3})?",
    r"\bxx/xx/xxxx\b",
    r"\bNaN\b",
    r"(?<!call to )\bundefined\b",
    r"\bXXX\b",
    r"\bTBD\b",
    r"\bDear <<",
]
_PLACEHOLDER = re.compile("|".join(_PLACEHOLDERS))
_MAYBE = re.compile(r"[{}<>\[\]%@$_【]|\.{6}|\((?i:name|insert|add|replace|enter|write|your)|NaN|undefined|XXX|TBD|TODO|FIXME|xx/")
_KEY = re.compile(r"\{\w+\}|tbd(?:_\d+)?|todo(?:_\d+)?|key_\d+", re.I)

_COMPILED = [(kind, re.compile(" (?:" + "|".join(f"(?:{f})" for f in forms) + ")(?= )")) for kind, forms in _FORMS]
#: What any match of a kind's forms holds; the forms are tried on the few texts with such a word.
_HINTS = {
    "script_notice": ["script", " js ", "cookie", "adblocker", "ad blocker", "your browser", "脚本"],
    "error_page": [
        "bad request", "unauthorized", "payment required", "forbidden", "not found", "not allowed", "not acceptable", "time out", "timeout", "409 conflict", "410 gone", "too large", "too long", "unsupported media", "unprocessable", "too many", "legal reasons", "server error", "not implemented",
        "gateway", "unavailable", "not supported", "not available", "access denied", "access blocked", " you ", "is broken", "is dead", "is gone", "is missing", "seems broken", "seems dead", "seems gone", "seems missing", "to be broken", "to be dead", "to be gone", "to be missing", "be broken", "be dead", "be gone", "be missing",
        "nicht gefunden", "nicht erreichbar", "nicht verfügbar", "existiert nicht", "页面", "网页", "链接", "文件", "went wrong", "error", "expired", "timed out", "connection", "exception", " for maintenance", "maintenance ", "traceback",
    ],
    "filler": ["lorem", "placeholder", "dummy", "filler", "blind", " here ", "coming soon", "to follow", "to come", "to be added", "something", "anything", "文字", "文本", "内容", "xxxx", "yyyy", "zzzz"],
    "keys": sorted({row[i : i + 4] for row in ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm") for i in range(len(row) - 3)} - {"wert"}),
}


def _automaton() -> object:
    import ahocorasick

    a, kinds = ahocorasick.Automaton(), {}
    for kind, hints in _HINTS.items():
        for h in hints:
            kinds.setdefault(h, []).append(kind)
    for h, ks in kinds.items():
        a.add_word(h, tuple(ks))
    a.make_automaton()
    return a


_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm")


def repeated(words: list[str]) -> set[int]:
    """Places in runs that say nothing: one word thrice (a number may stand between), or two words in turn, thrice."""
    hit: set[int] = set()
    if not any(a == c for a, c in zip(words, words[2:], strict=False)):
        return hit
    at = [i for i, w in enumerate(words) if not w.isdigit() and not "一" <= w[0] <= "鿿"]
    w = [words[i] for i in at]
    for k in range(len(w) - 2):
        if w[k] == w[k + 2] and at[k + 2] - at[k] < 4 and (w[k] == w[k + 1] or w[k : k + 2] * 2 == w[k + 2 : k + 6]):
            hit.update(range(at[k], at[k + 2] + 1))
    return hit


def neighbouring(words: list[str]) -> set[int]:
    """Places of words typed along a row of keys, if two stand close together."""
    keys = [i for i, x in enumerate(words) if len(x) >= 4 and x != "wert" and any(x in row for row in _ROWS)]
    return {k for i, j in zip(keys, keys[1:], strict=False) if j - i < 4 for k in range(i, j + 1)}


#: The share of a text's words in residue from which on a text is trusted; above 0.2, so that a text near it at 0.8 holds some.
TRUST = 0.3


class Judge:
    """(kind of residue or None, whether so much of it is residue that it is trusted) of a text; built once per worker."""

    def __init__(self, forms: list[tuple[str, re.Pattern]] | None = None) -> None:
        self.forms = _COMPILED if forms is None else forms
        self.hints = _automaton()

    def __call__(self, text: str, words: list[str] | None = None) -> tuple[str | None, bool]:
        words = WORD.findall(text.casefold()) if words is None else words
        kind, spoiled = None, 0
        if _MAYBE.search(text):
            rest, n = _PLACEHOLDER.subn(" ", text)
            if n:
                kind, spoiled = "placeholder", len(words) - len(WORD.findall(rest))
                if not WORD.search(rest):
                    return kind, False
        joined = f" {' '.join(words)} "
        hinted = {k for _, ks in self.hints.iter(joined) for k in ks}
        if hinted:
            for found, form in self.forms:
                if found in hinted and (said := sum(m[0].count(" ") for m in form.finditer(joined))):
                    kind = found if kind in (None, "placeholder") else kind
                    spoiled += said
        idle = repeated(words)
        if "keys" in hinted:
            idle |= neighbouring(words)
        if n := len(idle) or _latin(words):
            kind, spoiled = "filler" if kind in (None, "placeholder") else kind, spoiled + n
        if kind in (None, "placeholder"):
            return kind, False
        return kind, spoiled >= TRUST * sum(not any(c.isdigit() for c in w) for w in words)  # codes and references are no content


def _latin(words: list[str]) -> int:
    if LATIN.isdisjoint(words):
        return 0
    at = [i for i, w in enumerate(words) if w in LATIN]
    for k in range(len(at) - LATIN_HELD + 1):
        if at[k + LATIN_HELD - 1] - at[k] < LATIN_SPAN:
            return at[-1] - at[k] + 1
    return 0


def key_is_residue(key: str) -> bool:
    return _KEY.fullmatch(key.strip()) is not None
