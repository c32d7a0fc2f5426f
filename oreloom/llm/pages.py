"""Keyword-stuffed and link-list pages (problem 9).

A page is cut into line units; a hidden Markov model labels each as prose, link list, tag list or menu; pages are flagged
by the share of their text that is not prose. Emissions have two parts: what can be counted in any script (short words,
separators, links, tags, repeated terms, figures), and the weights of the unit's terms, fitted on all documents: the first
part alone labels their units, and a term weighs the log of how much more often it stands in prose than elsewhere. No word of any language is given. Terms are words, or pairs of characters in scripts without blanks.

The units of many texts are read at once (numpy); only those that are not plain sentences are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import compress, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreloom.session import spread

PROSE, LINKS, TAGS, MENU = range(4)
LABELS = ("prose", "link list", "tag list", "menu")
#: A page is flagged if more than this share of its text is labelled other than prose; short runs inside lists pass for prose, hence less than half.
MAX_OTHER = 0.4
#: Words per unit; a longer line is cut at sentence ends, then by number of words.
UNIT_WORDS = 24

#: Words of so few letters carry no subject in scripts with spaces: articles, prepositions, forms of to be.
SHORT = 3
#: Terms kept: the most frequent of the documents, of at least FIT_LEAST occurrences each.
FIT_TERMS, FIT_LEAST = 20_000, 8
#: Bound of one term's weight, and what the mean weight of a unit counts in its log-likelihoods.
FIT_CLIP, FIT_SCALE = 4.5, 5.0
#: Weights are multiples of it, so that their sums are exact in any order.
FIT_STEP = 2.0**-32
#: A unit of plain sentences whose terms count less than this is looked at closely.
LEAST_LEAN = -0.3

_HOST = r"(?<![\w@.])[a-z0-9-]*[a-z][a-z0-9-]*(?:\[?\.\]?[a-z0-9-]+)*\[?\.\]?[a-z]{3,}"
_URL = re.compile(rf"(?:[hH](?:tt|xx)[pP][sS]?|[fF][tT][pP])[:\[\]]*//\S+|[wW]{{3}}\.\S+|{_HOST}(?:/\S*|(?![\w-]))")
_ANCHOR = re.compile(r"</?a\b[^>]*>|\[[^\[\]]*\]\([^()\s]*\)", re.I)
_WORD, _RUN = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)"), re.compile(r"\w+")
# Of ASCII: letters in lower case, 0 for figures and underscores, a blank for the rest.
_PLAIN = bytes(ord(c.lower() if c.isalpha() else "0" if c.isdigit() or c == "_" else " ") if ord(c) < 128 else 0 for c in map(chr, range(256)))
_SEPARATOR = re.compile(r"[|;,•·»›>/*~]|\s[-–—]+\s|\t")
_STRONG = re.compile(r"[|;•·»›]|\s[/>–—-]\s")
_PAUSE = re.compile(r"[.,;:!?]")
_ITEM = re.compile(r"\s[>|»›]\s|^\s*[»›•]|\(\d+\)\s*$|\b[A-Z]\d{1,4}-\w|\bsku\s?-?\d", re.I)
_TAG = re.compile(r"(?<!\w)#\s?\w|\bsku\s?-?\d", re.I)
_SENTENCE = re.compile(r"(?<=[.!?。！？؟])\s+")
_REFERENCE = re.compile(r"^\s*(?:\[\d+\]|\(\d+\)|\d+\.)\s+\S.*\b(?:1[89]|20)\d\d\.?(?:\s|$)")
_ASSIGNED, _LEADERS = re.compile(r"=\s*[-+]?\d"), re.compile(r"\.{4,}\s*\d")
_COLUMNS, _CELLS = re.compile(r"\d[\d.,]*\s+\d[\d.,]*\s+\d[\d.,]*\s+\d"), re.compile(r"[|;\t]\s*-?\d[\d.,]*\s*[|;\t]\s*-?\d")
_CAPTION = re.compile(r"\s*(?:fig(?:ure|ura)?|table|tabla|tableau|tabelle|abbildung)\b", re.I)
_FOREIGN = re.compile(r"[\u0370-\u1fff\u2e80-\U0003ffff]")
# Scripts without blanks between words, read as pairs of characters; a word of the other scripts is what stands between blanks, figures and marks.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
_TERM = re.compile(r"[^\s\d!-/:-@\[-`{-~\u00a0-\u00bf\u2000-\u206f\u3000-\u3020\u30fb\uff00-\uff20؟،؛٪।॥]+")
_ANY_PAUSE = re.compile(r"[.,;:!?。、，；：！？؟،؛।॥]")
_ANY_END = re.compile(r"[.!?。！？؟।॥](?!\d)")
_MARKED = re.compile(r"[#|;•·»›>~\t=]|\.{4}").search
_LINKED = re.compile(r"\.(?:(?<=www\.)|(?<=[a-z0-9]\.)[a-z]{3,})|\[\.\]|<a\b", re.I)  # begins with marks, which are looked for fast
_URL_DOT = re.compile(r"\.(?:\]?[a-z]{3}|(?<=[wW]{3}\.)\S)").search  # in every match of _URL without two slashes
_DOTTED = re.compile(r"\.(?:[^\W\d_]|(?<=[wW]{3}\.))").search
_INVISIBLE = re.compile("[\u200b\u200c\u200d\ufeff\xad\u2060]")

#: Characters of texts that are read at once, and units of a long text that are measured at once; both bound the memory of a Python worker.
SLICE_CHARS, SLICE_UNITS = 200_000, 5_000
# Kinds of characters; those of _MARKED and of _SEPARATOR stand in a row each.
_LETTER, _FIGURE, _MARK, _BOTH, _TAB, _SEPARATES, _COMMA, _DOT, _DASH, _SPACE, _BREAK = range(1, 12)


def _kind(c: str) -> int:
    """What a character counts as; letters are what _WORD takes, figures what no word may touch."""
    if c.isalnum() or c == "_":
        return _FIGURE if c == "_" or c.isdecimal() else _LETTER
    if found := {",": _COMMA, ".": _DOT, "\n": _BREAK, "\t": _TAB, "-": _DASH, "–": _DASH, "—": _DASH}.get(c):
        return found
    return (_BOTH if _SEPARATOR.match(c) else _MARK) if _MARKED(c) else _SEPARATES if _SEPARATOR.match(c) else _SPACE if c.isspace() else 0


_KINDS = np.array([_kind(chr(i)) for i in range(0x10000)], np.uint8)
# Of ASCII: the kinds as bytes; letters, figures and underscores as they are, a blank for the rest.
_ASCII_KINDS = _KINDS[:256].tobytes()
_ASCII_WORDS = bytes(c if _KINDS[c] in (_LETTER, _FIGURE) else 32 for c in range(128)) + bytes(128)

#: Log-probability of moving from a label to itself, and to each other one.
_STAY, _MOVE = -0.2, -2.2


def line_units(text: str) -> list[str]:
    """Non-blank units of a text, in order: lines, and pieces of lines of more than UNIT_WORDS words."""
    out = []
    for line in text.splitlines():
        if not line.strip():
            continue
        if len(line) < 6 * UNIT_WORDS:
            out.append(line)
            continue
        for sentence in _SENTENCE.split(line):
            if len(sentence) < 4 * UNIT_WORDS:  # of no more words than that by its length
                if sentence and not sentence.isspace():
                    out.append(sentence)
                continue
            words = sentence.split()
            if len(words) <= 2 * UNIT_WORDS:
                if len(words) == 1 and len(sentence) > 400:
                    out.extend(sentence[i : i + 400] for i in range(0, len(sentence), 400))
                elif words:
                    out.append(sentence)
            else:
                out.extend(" ".join(words[i : i + UNIT_WORDS]) for i in range(0, len(words), UNIT_WORDS))
    return out


def words_of(unit: str) -> list[str]:
    """Lower-case words of a unit, as _WORD finds them: the runs of word characters without figures and underscores."""
    if not unit.isascii():
        return [w for w in _RUN.findall(unit.lower()) if w.isalpha() or _WORD.fullmatch(w)]
    plain = unit.encode().translate(_PLAIN)
    words = plain.decode().split()
    return [w for w in words if "0" not in w] if b"0" in plain else words


def is_data(unit: str) -> bool:
    """Figures, contents lines and captions: assigned values, leaders, numbers in a row or in cells. The marks are looked for first."""
    return bool(
        ("=" in unit and _ASSIGNED.search(unit)) or ("...." in unit and _LEADERS.search(unit)) or _COLUMNS.search(unit)
        or (("|" in unit or ";" in unit or "\t" in unit) and _CELLS.search(unit)) or (unit.lstrip()[:1] in "fFtTaA" and _CAPTION.match(unit))
    )


def stuffed_terms(counts: Counter, total: int) -> set[str]:
    """Words repeated far beyond what prose on one subject does: 8 % of the page's words each and at least four times (short
    words 18 % and eight times), 12 % together.
    """
    floor, short_floor = max(4, 0.08 * total), max(8, 0.18 * total)
    if not counts or max(counts.values()) < floor:
        return set()
    found = {w: n for w, n in counts.items() if n >= floor and len(w) > 2 and (len(w) > SHORT or n >= short_floor)}
    return set(found) if sum(found.values()) >= 0.12 * total else set()


def is_foreign(unit: str) -> bool:
    """In a script where short words say nothing about prose."""
    return not unit.isascii() and len(_FOREIGN.findall(unit)) > 0.2 * len(unit)


def foreign_terms(unit: str) -> list[str]:
    """Words of a unit in any script; pairs of neighbouring characters where words are not set apart."""
    out = []
    for word in _TERM.findall(unit.lower()):
        for run in _UNSPACED.findall(word):
            out.extend(run[i : i + 2] for i in range(max(1, len(run) - 1)))
        out.extend(w for w in _UNSPACED.split(word) if w)
    return out


def foreign_stuffing(units: list[str]) -> list[float]:
    """Share of stuffed terms in each unit of a foreign script (0 for other units).

    Terms are stuffed as in other pages, or if those of at least 1 % and four times make up half of the foreign text. As
    function words are not known, a text set out in sentences (a pause in 30 words, or 60 pairs) is told from keywords by
    the unit: there a term counts only if it comes back inside a sentence.
    """
    terms = [foreign_terms(u) if is_foreign(u) and not is_data(u) else [] for u in units]
    counts = Counter(w for ws in terms for w in ws)
    total = sum(counts.values())
    often = {w: n for w, n in counts.items() if n >= max(4, 0.01 * total) and (len(w) > 2 or _UNSPACED.match(w))}
    most = {w: n for w, n in often.items() if n >= 0.08 * total}
    stuffed = set(often) if sum(often.values()) >= 0.5 * total else set(most) if sum(most.values()) >= 0.12 * total else set()
    if not stuffed:
        return [0.0] * len(units)
    span = sum(n / (60 if _UNSPACED.match(w) else 30) for w, n in counts.items())
    paused = sum(len(_ANY_PAUSE.findall(u)) for u, ws in zip(units, terms, strict=True) if ws) >= max(1.0, span)
    out = []
    for u, ws in zip(units, terms, strict=True):
        share = sum(w in stuffed for w in ws) / len(ws) if ws else 0.0
        if share and paused:
            once = max(1, len(_ANY_END.findall(u)))
            again = sum(max(0, n - once) for w, n in Counter(ws).items() if w in stuffed)
            share = share if again >= 0.15 * len(ws) else 0.0
        out.append(share)
    return out


def terms_of(unit: str, words: list[str]) -> list[str]:
    """What a unit is weighed by: its words, or its terms in a foreign script."""
    return foreign_terms(unit) if is_foreign(unit) else words


def weigh(unit: str, words: list[str], weights: dict[str, float]) -> float:
    """Mean weight of the unit's terms, those that were not fitted counting nothing, less in units of a few terms."""
    known = [x for x in map(weights.get, terms_of(unit, words)) if x is not None]
    return sum(known) / max(8, len(known)) if known else 0.0


def weigh_all(words: list[str], ends: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """weigh of units that are in no foreign script, from the words of all and where those of each end."""
    known = np.fromiter(map(weights.get, words, repeat(np.nan)), float, len(words))
    lost = np.isnan(known)
    known[lost] = 0.0
    whole, n = (np.diff(np.append(0, np.cumsum(x))[ends], prepend=0) for x in (np.rint(known / FIT_STEP).astype(np.int64), ~lost))
    return whole * FIT_STEP / np.maximum(8, n)


def sentences(lean: float) -> tuple[float, float, float, float]:
    """Log-likelihoods of a unit of plain sentences."""
    return 2.2 + max(0.0, lean), -3.0, -1.4, -1.2


class Measures(NamedTuple):
    """What measured finds in a unit: its short words, separators (-1: a dash after a blank, which only the pattern tells), commas, marks of _MARKED, numbers (runs of figures)."""

    short: int
    separators: int
    commas: int
    marks: int
    numbers: int


def may_be_data(unit: str, rows: bool) -> bool:
    """Whether is_data has anything to look for: rows or marks, or a caption."""
    return rows or unit.lstrip()[:1] in "fFtTaA"


def emission(unit: str, words: list[str], found: Measures, stuffed: set[str], short_lines: bool, linked: bool, foreign: bool, weight: float = 0.0, repeated: float = 0.0) -> tuple[float, float, float, float]:
    """Log-likelihoods (up to a constant) of a unit that is not told by is_plain under the four labels; linked: whether the text may
    hold links; weight: that of its terms; repeated: its foreign_stuffing.
    """
    n = len(words)
    common = found.short / n if n else 0.0
    lean = FIT_SCALE * weight
    links = len(_URL.findall(unit)) if linked and ("//" in unit or _URL_DOT(unit)) else 0
    if not n and not links:
        return 0.0, -1.5, -1.5, -1.5
    bare, inner = unit, words
    if links:
        bare = _URL.sub(" ", _ANCHOR.sub(lambda a: a[0] if a[0][0] == "[" else " ", unit))
        inner = words_of(bare)
        common = len([1 for w in inner if len(w) <= SHORT]) / max(1, len(inner))
    m = max(1, len(inner))
    separators = len(_SEPARATOR.findall(bare)) if links or found.separators < 0 else found.separators
    strong = len(_STRONG.findall(bare)) if separators >= 3 else 0
    tags = len(_TAG.findall(unit)) if "#" in unit or "sku" in unit.lower() else 0
    stuffing = repeated if foreign else len([1 for w in inner if w in stuffed]) / m if stuffed else 0.0
    data = not links and may_be_data(unit, found.marks > 0 or found.numbers >= 4) and is_data(unit)
    reference = links <= 1 and found.numbers >= 2 and bool(_REFERENCE.match(unit))
    sentence = m >= 5 and bare.rstrip(" )\"'»”").endswith((".", "!", "?", "。", "！", "？", "؟"))
    if stuffing and not foreign and sentence and common >= 0.2 and not any(inner.count(w) > 1 for w in stuffed):
        stuffing *= 0.3  # said once in a full sentence: a subject, not a keyword
    if foreign:
        prose = 1.5
    elif m <= 3 and not (separators or tags or links or stuffing):
        prose = 0.0
    else:
        prose = 2.2 if common >= 0.22 else 0.8 if common >= 0.12 else -0.6 if common > 0 else -1.6
        if prose > 0:
            prose *= min(1.0, m / 8)
        prose += 0.6 if sentence else 0.0
    if data or reference:
        return prose + 4.0, -3.0, -1.4, -1.2
    prose += lean
    tag = -1.4 + min(4.0, 7.0 * max(0.0, separators / m - 0.16)) + min(4.0, 1.2 * tags) + 30.0 * max(0.0, stuffing - 0.05)
    tag += min(4.0, 20.0 * max(0.0, strong / m - 0.08)) if strong >= 3 else 0.0
    tag += 0.8 if m >= 2 and common == 0 and separators / m >= 0.25 else 0.0
    tag += 1.5 if m >= 8 and common < 0.05 and prose < 1.0 else 0.0
    tag += 2.0 if m >= 16 and common < 0.3 and not (_ANY_PAUSE if foreign else _PAUSE).search(bare) else 0.0
    tag -= min(0.0, lean)
    link = -1.2 + min(4.5, 24.0 * links / (m + 4)) + (1.0 if m <= 8 and not sentence else 0.0) if links else -3.0
    menu = -1.2
    if not sentence and not foreign and m <= 10:
        if (found.marks or found.numbers) and _ITEM.search(unit):
            menu = 2.0
        elif short_lines and m <= 7 and common < 0.3:
            menu = 0.9
    return prose, link, tag, menu


class Page(NamedTuple):
    """Units of a text, the most probable label of each, and the words of all: those of unit i end before ends[i]."""

    units: list[str]
    labels: list[int]
    words: list[str]
    ends: list[int]
    rows: list[bool]  # may hold figures in rows, or what is_data looks for by a mark
    foreign: bool  # some unit may be in a foreign script


def measured(units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of all units in one list (words_of of each), where those of each unit end in it, and a row of Measures of each.
    All units are read at once, since reading each by itself is most of what labelling costs.
    """
    lower = "\n".join(["", *units, ""]).lower()
    if lower.isascii():
        kinds = np.frombuffer(lower.encode().translate(_ASCII_KINDS), np.uint8)
    else:
        points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _KINDS.take(points, mode="clip")
        if points.max() > 0xFFFF:
            high = np.flatnonzero(points > 0xFFFF)
            seen, at = np.unique(points[high], return_inverse=True)
            kinds[high] = np.array([_kind(chr(c)) for c in seen], np.uint8)[at]
    figures = kinds == _FIGURE
    inside = kinds - np.uint8(1) < _FIGURE
    if lower.isascii():
        runs = lower.encode().translate(_ASCII_WORDS).decode().split()
    else:
        runs = np.where(inside, points, 32).astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass").split()
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    whole = np.ones(len(starts), bool)
    whole[np.searchsorted(starts, np.flatnonzero(figures), "right") - 1] = False
    starts, lengths = starts[whole], lengths[whole]
    breaks = np.flatnonzero(kinds == _BREAK)[1:]
    by_unit = lambda at: np.diff(np.searchsorted(at, breaks), prepend=0)
    marks = kinds - np.uint8(_MARK) <= _TAB - _MARK
    dots = np.flatnonzero(kinds == _DOT)
    marks[dots[:-3][dots[3:] - dots[:-3] == 3]] = True
    dashes = np.flatnonzero(kinds == _DASH)
    before = kinds[dashes - 1]
    separators = by_unit(np.flatnonzero(kinds - np.uint8(_BOTH) <= _COMMA - _BOTH))
    separators[by_unit(dashes[(before == _SPACE) | (before == _TAB)]) > 0] = -1
    numbers = np.flatnonzero(figures[1:] & ~figures[:-1]) + 1
    found = [by_unit(starts[lengths <= SHORT]), separators, by_unit(np.flatnonzero(kinds == _COMMA)), by_unit(np.flatnonzero(marks)), by_unit(numbers)]
    return list(compress(runs, whole.tolist())), np.searchsorted(starts, breaks), np.stack(found, 1)


def is_plain(sizes: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which units are set out as plain sentences, by their number of words and rows of Measures."""
    short, _, commas, marks, _ = found.T
    return (sizes >= 8) & (short / np.maximum(1, sizes) >= 0.22) & (commas < 0.16 * sizes) & (marks == 0)


def is_linked(text: str) -> bool:
    """Whether a text may hold links. A dot before a letter is looked for first, which is fast."""
    return "://" in text or ((_DOTTED(text) or "[.]" in text or "<a" in text or "<A" in text) and bool(_LINKED.search(text)))


def labelled(texts: Iterable[str | None], weights: dict[str, float] | None = None) -> Iterator[Page]:
    """Every text's Page, in order; null and blank texts have no units."""
    part, size = [], 0
    for text in texts:
        text = text or ""
        part.append(text if text.isascii() else _INVISIBLE.sub("", text))
        size += len(text)
        if size >= SLICE_CHARS:
            yield from _labelled(part, weights)
            part, size = [], 0
    if part:
        yield from _labelled(part, weights)


def _labelled(texts: list[str], weights: dict[str, float] | None) -> Iterator[Page]:
    """Pages of some texts, without invisible characters; those of ASCII are read together, and so are the others."""
    plain = [t.isascii() for t in texts]
    kinds = [iter(_read([t for t, a in zip(texts, plain, strict=True) if a == kind], weights)) for kind in (False, True)]
    return (next(kinds[a]) for a in plain)


def _read(texts: list[str], weights: dict[str, float] | None) -> list[Page]:
    """Pages of some texts. Only units that are not told by is_plain are scored one by one."""
    split = [line_units(t) for t in texts]
    units = [u for own in split for u in own]
    parts = [measured(units[i : i + SLICE_UNITS]) for i in range(0, max(1, len(units)), SLICE_UNITS)]
    words, found = [w for p in parts for w in p[0]] if len(parts) > 1 else parts[0][0], np.concatenate([p[2] for p in parts])
    ends = np.concatenate([p[1] + before for p, before in zip(parts, np.cumsum([0, *(len(p[0]) for p in parts)]), strict=False)])
    sizes = np.diff(ends, prepend=0)
    rows = ((found[:, 3] > 0) | (found[:, 4] >= 4)).tolist()
    owner = np.repeat(np.arange(len(texts)), [len(own) for own in split])
    short_lines = np.bincount(owner, sizes <= 6, len(texts)) > 0.6 * np.bincount(owner, minlength=len(texts))
    leans = weigh_all(words, ends, weights) if weights else np.zeros(len(units))
    bounds, repeated, pages, marked = [0, *ends.tolist()], [0.0] * len(units), [], []
    first = 0
    for text, own, short in zip(texts, split, short_lines.tolist(), strict=True):
        last = first + len(own)
        begin = bounds[first]
        page = Page(own, [PROSE] * len(own), words[begin : bounds[last]], [e - begin for e in bounds[first + 1 : last + 1]], rows[first:last], not text.isascii() and bool(_FOREIGN.search(text)))
        if page.foreign:
            repeated[first:last] = foreign_stuffing(own)
            if weights:
                leans[first:last] = [weigh(u, words[a:b], weights) for u, a, b in zip(own, bounds[first:last], bounds[first + 1 : last + 1], strict=True)]
        pages.append(page)
        marked.append((_stuffed(page), short and len(own) >= 5, is_linked(text), page.foreign))
        first = last
    calm = np.array([not stuffed and not linked for stuffed, _, linked, _ in marked], bool)
    plain = is_plain(sizes, found) & calm[owner] & (FIT_SCALE * leans > LEAST_LEAN)
    owners, weight, scores, doubted = owner.tolist(), leans.tolist(), {}, set()
    for i, f in zip(np.flatnonzero(~plain).tolist(), found[~plain].tolist(), strict=True):
        u, (stuffed, short, linked, foreign) = units[i], marked[owners[i]]
        s = emission(u, words[bounds[i] : bounds[i + 1]], Measures._make(f), stuffed, short, linked, foreign and is_foreign(u), weight[i], repeated[i])
        scores[i] = s
        if s[PROSE] < max(s):
            doubted.add(owners[i])
    firsts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    for k in doubted:
        pages[k].labels[:] = best_path([scores.get(i) or sentences(FIT_SCALE * weight[i]) for i in range(firsts[k], firsts[k + 1])])
    return pages


def _stuffed(page: Page) -> set[str]:
    """stuffed_terms of a page; figures and contents lines repeat their terms by nature, and don't count where it matters."""
    stuffed = stuffed_terms(Counter(page.words), len(page.words))
    if not stuffed:
        return stuffed
    told = [w for u, a, b in zip(page.units, [0, *page.ends[:-1]], page.ends, strict=True) if not is_data(u) for w in page.words[a:b]]
    return stuffed_terms(Counter(told), len(told))


def best_path(scores: list[tuple[float, float, float, float]]) -> list[int]:
    """The most probable label of each unit of a text (Viterbi)."""
    best = [scores[0][k] + (0.7 if k == PROSE else 0.0) for k in range(4)]
    back = []
    for s in scores[1:]:
        top = max(range(4), key=best.__getitem__)
        jump = best[top] + _MOVE
        step, new = [], []
        for k in range(4):
            stay = best[k] + _STAY
            step.append(k if stay >= jump else top)
            new.append(max(stay, jump) + s[k])
        back.append(step)
        best = new
    k = max(range(4), key=best.__getitem__)
    path = [k]
    for step in reversed(back):
        k = step[k]
        path.append(k)
    return path[::-1]


def label_units(text: str, weights: dict[str, float] | None = None) -> tuple[list[str], list[int]]:
    """Units of a text and the most probable label of each."""
    return next(labelled([text], weights))[:2]


def share_of(page: Page) -> float:
    """Share of a page's text (characters of its units) that is not prose; 0 for null, empty and blank texts."""
    if not any(page.labels):
        return 0.0
    return sum(len(u) for u, k in zip(page.units, page.labels, strict=True) if k != PROSE) / max(1, sum(map(len, page.units)))


def other_share(text: str | None, weights: dict[str, float] | None = None) -> float:
    """share_of one text."""
    return share_of(next(labelled([text], weights)))


def count_page(page: Page, told: Counter, other: Counter) -> None:
    """Adds the terms of a page in units that count as prose, and in others; figures and contents lines not."""
    data = [may_be_data(u, r) and is_data(u) for u, r in zip(page.units, page.rows, strict=True)]
    if not page.foreign and not any(data) and not any(page.labels):
        told.update(page.words)
        return
    sides = ([], [])
    for u, label, d, a, b in zip(page.units, page.labels, data, [0, *page.ends[:-1]], page.ends, strict=True):
        if not d:
            words = page.words[a:b]
            sides[label != PROSE].extend(terms_of(u, words) if page.foreign else words)
    told.update(sides[0])
    other.update(sides[1])


def count_terms(text: str | None, told: Counter, other: Counter) -> None:
    """count_page of one text, labelled by what is counted alone."""
    count_page(next(labelled([text])), told, other)


def fitted(rows: list[tuple[str, int, int]]) -> dict[str, float]:
    """Weight of each term from (term, occurrences in prose, elsewhere): the smoothed log ratio of its rates, bounded.

    Without a term on either side there is nothing to tell apart, and all weights are 0.
    """
    told, other = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not told or not other:
        return {}
    rate = lambda n, whole: (n + 1.0) / (whole + len(rows))
    return {w: FIT_STEP * round(max(-FIT_CLIP, min(FIT_CLIP, math.log(rate(a, told) / rate(b, other)))) / FIT_STEP) for w, a, b in rows}


def fit_weights(documents: DataFrame, most: int | None = None) -> dict[str, float]:
    """Weights fitted on all documents, or on about ``most`` of them where a caller asks for that many (by hash of the id, hence
    the same at any partitioning). At most FIT_TERMS rows of counts reach the driver.
    """
    part = documents.select("doc_id", "text")
    if most is not None and (whole := documents.count()) > most:
        part = part.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < max(1, most * 1_000_000 // whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, other = Counter(), Counter()
            for page in labelled(t.as_py() for t in batch.column(0)):
                count_page(page, told, other)
            terms = list(told | other)
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "told": pa.array([told[t] for t in terms], pa.int64()), "other": pa.array([other[t] for t in terms], pa.int64())})

    counts = spread(part.select("text")).mapInArrow(run, "term string, told bigint, other bigint").groupBy("term").agg(F.sum("told").alias("told"), F.sum("other").alias("other"))
    often = counts.filter(F.col("told") + F.col("other") >= FIT_LEAST).orderBy(F.desc(F.col("told") + F.col("other")), "term").limit(FIT_TERMS)
    return fitted([tuple(r) for r in often.collect()])


def page_shares(documents: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id and other_share double of every document, in one map over Arrow batches; no shuffle but for the counts of terms."""
    weights = documents.sparkSession.sparkContext.broadcast(fit_weights(documents, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [share_of(page) for page in labelled((t.as_py() for t in batch.column(1)), weights.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], names=["doc_id", "other_share"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return spread(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {id_type}, other_share double")


def spam_pages(documents: DataFrame, max_other: float = MAX_OTHER) -> DataFrame:
    """doc_id of pages most of whose text is keywords, links or tags, distinct."""
    return page_shares(documents).filter(f"other_share > {max_other}").select("doc_id").distinct()
