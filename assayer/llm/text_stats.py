"""Statistics of one text: what tells prose from lists, tables and junk.

``measure`` gives the numbers of COLUMNS for a text. Han signs count as words of their own. Ratios
are of the characters that are not white space unless the name says otherwise; they are rounded to
four decimals and mean word length to two, which also bounds how many distinct values there are.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

COLUMNS = (
    "n_words", "mean_word", "longest_word", "symbol_ratio", "digit_ratio", "line_end_ratio", "common_ratio",
    "distinct_ratio", "vowel_ratio", "broken_ratio", "tag_ratio", "cell_share", "entry_share", "sentence_share", "n_lines",
)

# The commonest words of each language.
COMMON = {
    "en": frozenset(
        """the of and to a in is was it for on with as by that this from at be or an are not which but had
        his they one you were her all she there would their we him been has when who will no more if out so
        what up its about into than them can only other some could these two may then do first any my now
        such like our over me even most after also many before must each every neither nor under between
        where while until since because although unless whenever nobody please does still near""".split()
    ),
    "de": frozenset(
        """der die das und in zu den nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch
        als an nach wie im für man aber aus durch wenn nur war noch werden bei hat wir was wird sein einen
        welche sind oder zur um haben einer mir über ihm diese einem ihr uns da zum kann doch vor dieser
        mich ihn du hatte seine mehr am denn nun unter sehr selbst schon hier bis habe ihre dann ihnen seiner
        alle wieder meine gegen vom ganz einzelnen wo muss ohne eines können sei niemand weil obwohl""".split()
    ),
    "fr": frozenset("le la les de des du et est un une dans que qui pour pas sur au aux ce cette avec il elle nous vous ils ne se par plus mais ou où son sa ses leur été être sont même comme".split()),
    "es": frozenset("el la los las de del y es un una en que por para no con se su sus al lo como más pero o ha son este esta fue ser está entre cuando muy sin sobre también me ya hay".split()),
    "it": frozenset("il lo la i gli le di del della e è un una in che per non con si suo sua al come più ma o ha sono questo questa fu essere tra quando molto senza anche nel alla dei".split()),
    "pt": frozenset("o a os as de do da dos das e é um uma em que por para não com se seu sua ao como mais mas ou foi são este esta ser entre quando muito sem também no na pelo".split()),
    "nl": frozenset("de het een en van in is dat op te zijn met voor niet aan er om ook als maar bij nog uit door naar heeft hij zij ze wij je dit die kan meer werd worden over".split()),
    "zh": frozenset("的一是不了在人有我他这中大来上个到说们为子和你地出也时年得就那要下以生会自着去之过家学对可里后小么心多天而能好都然没日于起还发成只如事把还用第样道想作种开从本但虽由否需有其与或被条款据"),
}
#: Languages told by their script alone: the range of its letters.
SCRIPTS = {"ru": "Ѐ-ӿ", "el": "Ͱ-Ͽ", "he": "֐-׿", "ar": "؀-ۿ", "hi": "ऀ-ॿ", "th": "฀-๿", "ja": "぀-ヿ", "ko": "가-힯"}
_SPOKEN: dict[str, list[str]] = {}
for _l, _ws in COMMON.items():
    if _l != "zh":
        for _w in (w for w in _ws if len(w) > 1 or _l in ("en", "de")):  # single letters are codes more often than words
            _SPOKEN.setdefault(_w, []).append(_l)
_ALL_COMMON = frozenset(_SPOKEN)
_SCRIPT = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_BROKEN = re.compile(r"�|ï¿½|â€.?|Ã.|Â")
_BREAK = re.compile(r"\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]")
_MARKER = re.compile(r"\s*(?:[-*•·▪◦–—+]|\[[ xX]?\]|\(?\d{1,4}[.)、]|#\d+|\(?[a-zA-Z][.)])\s*(?=\S)")
_END = re.compile(r"[.!?…。！？][\"”’')\]」』»“]*(?=\s|$)|[。！？]")
_LINE_END = re.compile(r"[.!?…:;。！？：；][\"”’')\]」』»“]*\s*$")
_BORDER = re.compile(r"[\s+|:=_-]{3,}")
_CSV = re.compile(r"(?:\"[^\"]*\"|[^\s,;\"][^,;\"]*|)(?:([,;])(?:\"[^\"]*\"|[^\s,;\"][^,;\"]*|)){1,}")
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
SHORT, SHORT_HAN = 64, 32
#: A sentence mark is due every so many words.
MOST_PER_SENTENCE = 60
WINDOW = 50


def _table_of_classes() -> np.ndarray:
    """Class of each sign of the basic plane: 1 space, 2 digit, 3 letter, 4 ordinary punctuation, 5 symbol."""
    out = np.full(0x10000, 5, np.uint8)
    for i in range(0x10000):
        kind = unicodedata.category(chr(i))
        out[i] = 1 if chr(i).isspace() else 2 if kind[0] == "N" else 3 if kind[0] in "LM" else 5
    for c in ".,;:!?'\"()-–—…’‘“”„«»/。，、；：！？（）《》「」『』·":
        out[ord(c)] = 4
    return out


_CLASS = _table_of_classes()
_VOWELS = np.zeros(0x10000, bool)
_LATIN = np.zeros(0x10000, bool)
for _c in "aeiouyäöüáéíóúàèìòùâêîôûåæøœ":
    _VOWELS[ord(_c)] = True
for _i in [*range(ord("a"), ord("z") + 1), *map(ord, "äöüßáéíóúàèìòùâêîôûåæøœçñ")]:
    _LATIN[_i] = True


def language(text: str, words: list[str], n_han: int, n_letters: int, latin: int) -> str:
    """By script where that tells, else by common words; und without any hint."""
    if latin * 2 < n_letters:
        for name, sign in _SCRIPT.items():
            if len(sign.findall(text)) > 0.3 * n_letters:
                return name
    if n_han > 0.3 * max(1, n_letters):
        return "zh"
    counts: dict[str, int] = {}
    shared: dict[str, int] = {}
    for w in words:
        if w in _ALL_COMMON:
            names = _SPOKEN[w]
            if len(names) == 1:
                counts[names[0]] = counts.get(names[0], 0) + 1
            elif names[0] in _FIRST:
                shared[names[0]] = shared.get(names[0], 0) + 1
    # Short words of other languages turn up as names and codes; two languages are told by any hint.
    counts = {k: n for k, n in counts.items() if k in _FIRST or n >= 3 and n * 20 >= len(words)} or shared
    return min(counts, key=lambda k: (-counts[k], _ORDER[k])) if counts else "und"


_FIRST = ("en", "de")
_ORDER = {k: i for i, k in enumerate(COMMON)}


def _is_row(line: str) -> bool:
    """Whether a line is a line of cells, by its separators."""
    body = line.strip()
    if _BORDER.fullmatch(body):
        return True
    if "\t" in body or body.count("|") >= 2 and (body[0] == "|" or body[-1] == "|"):
        return True
    if '";"' in body or '","' in body:
        return True
    if (m := _CSV.fullmatch(body)) is not None and (body.count(",") >= 2 or body.count(";") >= 2) and ", " not in body and "; " not in body and m[1]:
        return True
    gaps = [len(g) for g in _GAP.findall(body)]
    return bool(gaps) and max(gaps) >= (3 if len(gaps) > 1 else 4)  # text spaced out evenly is no row


def _pipes(line: str) -> int:
    return len(re.findall(r"\s\|\s", line))


def _shares(lines: list[str]) -> tuple[float, float, float]:
    """(characters in rows of cells, in short separate entries, in sentences) of the non-blank lines."""
    sizes = [len(x.strip()) for x in lines]
    total = sum(sizes)
    if not total:
        return 0.0, 0.0, 0.0
    rows = [bool(n) and _is_row(x) for x, n in zip(lines, sizes, strict=True)]
    piped = [_pipes(x) for x in lines]
    common = max(set(piped), key=piped.count) if any(piped) else 0
    if common >= 1 and piped.count(common) >= 3:
        rows = [r or p == common for r, p in zip(rows, piped, strict=True)]
    if sum(rows) < 2:
        rows = [False] * len(rows)
    cells = sum(n for n, r in zip(sizes, rows, strict=True) if r)
    entries = sentences = 0
    block: list[tuple[str, int]] = []

    def close() -> None:
        nonlocal entries, sentences
        if not block:
            return
        plain = []
        for x, n in block:
            m = _MARKER.match(x)
            han = len(_HAN.findall(x)) * 2 > n
            rest = x[m.end() :] if m else x
            marks = len(_END.findall(rest))
            short = n <= (SHORT_HAN if han else SHORT) or m and n <= 2 * SHORT and marks <= 1
            if m and short and not (marks and len(rest.split()) > 10):
                entries += n
            else:
                plain.append((x, n, marks, han))
        if plain:
            size = sum(n for _, n, _, _ in plain)
            text = " ".join(x for x, *_ in plain)
            ends = len(_END.findall(text))
            count = len(_HAN.findall(text)) if plain[0][3] else len(text.split())
            if ends and count <= MOST_PER_SENTENCE * ends:
                sentences += size
            elif all(n <= (SHORT_HAN if han else SHORT) for _, n, _, han in plain):
                entries += size
        block.clear()

    for x, n, r in zip(lines, sizes, rows, strict=True):
        if r or not n:
            close()
        else:
            block.append((x, n))
    close()
    return cells / total, entries / total, sentences / total


def measure(text: str) -> tuple[str, dict[str, float]]:
    """(language, statistics)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, 0xFFFF)
    kinds = np.bincount(_CLASS[low], minlength=6)
    solid = max(1, len(points) - int(kinds[1]))
    folded = text.casefold()
    words = _WORD.findall(folded)
    n_han = len(_HAN.findall(text))
    fold_points = np.minimum(np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    latin = int(_LATIN[fold_points].sum())
    lang = language(text, words, n_han, int(kinds[3]), latin)
    if n_han:
        words = [y for w in words for y in (_HAN.sub(lambda m: f" {m[0]} ", w).split() if _HAN.search(w) else [w])]
    n = len(words)
    lengths = np.array([len(w) for w in words] or [0])
    common = _ALL_COMMON if lang == "und" else COMMON.get(lang, frozenset())
    windows = [words[i : i + WINDOW] for i in range(0, n, WINDOW)]
    if len(windows) > 1 and len(windows[-1]) < WINDOW:
        windows.pop()
    lines = _BREAK.split(text)
    filled = [x for x in lines if x.strip()]
    cells, entries, sentences = _shares(lines)
    return lang, {
        "n_words": n,
        "mean_word": round(float(lengths.mean()), 2),
        "longest_word": int(lengths.max()),
        "symbol_ratio": round(int(kinds[5]) / solid, 4),
        "digit_ratio": round(int(kinds[2]) / solid, 4),
        "line_end_ratio": round(sum(bool(_LINE_END.search(x)) for x in filled) / max(1, len(filled)), 4),
        "common_ratio": round(sum(w in common for w in words) / max(1, n), 4),
        "distinct_ratio": round(sum(len(set(w)) for w in windows) / max(1, sum(map(len, windows))), 4),
        "vowel_ratio": round(int(_VOWELS[fold_points].sum()) / latin, 4) if latin else 0.0,
        "broken_ratio": round(sum(len(m) for m in _BROKEN.findall(text)) / solid, 4),
        "tag_ratio": round(sum(len(m) for m in _TAG.findall(text)) / max(1, len(text)), 4),
        "cell_share": round(cells, 4),
        "entry_share": round(entries, 4),
        "sentence_share": round(sentences, 4),
        "n_lines": len(filled),
    }


#: Signs of junk: statistic, sign (1: high), from where on it is possible, from where on it is certain,
#: and what must hold besides (words at least; in Latin script only). Between the two the outlier score decides.
SIGNS = (
    ("tag_ratio", 1, 0.5, 0.8, 0, False),
    ("broken_ratio", 1, 0.08, 0.3, 0, False),
    ("symbol_ratio", 1, 0.35, 0.48, 0, False),
    ("distinct_ratio", -1, 0.42, 0.06, 15, True),
    ("vowel_ratio", -1, 0.3, 0.05, 1, True),
    ("common_ratio", 1, 0.8, 0.99, 15, True),
    ("digit_ratio", 1, 0.8, 0.98, 8, False),
    ("mean_word", 1, 18.0, 30.0, 1, True),
)
#: Statistics whose tail in the given direction speaks for junk (0: either).
DIRECTIONS = {"symbol_ratio": 1, "digit_ratio": 1, "broken_ratio": 1, "tag_ratio": 1, "vowel_ratio": -1, "distinct_ratio": -1, "longest_word": 1, "mean_word": 1, "sentence_share": -1, "line_end_ratio": -1, "common_ratio": 0}
#: A text with a possible sign is junk if its outlier score over DIRECTIONS is as high as this.
OUTLIER = 11.0


def signs(s: dict[str, float], lang: str) -> tuple[bool, bool]:
    """(whether junk is possible, whether it is certain) by a text's own statistics."""
    if s["n_words"] == 0:
        return s["symbol_ratio"] > 0, s["symbol_ratio"] > 0
    possible = False
    for name, sign, loose, strict, words, latin in SIGNS:
        v = s[name]
        if s["n_words"] < words or latin and lang in _NO_WORDS or sign * v <= sign * loose:
            continue
        if s["cell_share"] > 0.5 and name in _OF_TABLES_TOO or name == "vowel_ratio" and (not v or s["digit_ratio"] >= 0.5 or s["n_words"] * s["mean_word"] < 40) or name == "mean_word" and s["n_words"] * v < 60:
            continue
        possible = True
        if sign * v > sign * strict:
            return True, True
    return possible, False


#: Signs that a table may show as well.
_OF_TABLES_TOO = frozenset(["symbol_ratio", "distinct_ratio", "vowel_ratio", "digit_ratio"])
_NO_WORDS = frozenset(["zh", *SCRIPTS])


def structure(s: dict[str, float]) -> str:
    """What a text is if it is not junk."""
    if s["cell_share"] > 0.5:
        return "table"
    return "list" if s["entry_share"] > 0.5 and s["n_lines"] >= 3 else "prose"


def shape(s: dict[str, float], lang: str, outlier: float | None = None) -> str:
    """The shape by the statistics, and by the outlier score where these leave it open; without a score, not junk then."""
    possible, certain = signs(s, lang)
    return "junk" if certain or possible and outlier is not None and outlier >= OUTLIER else structure(s)
