"""Repairing text from scanned pages.

Page numbers that count up along a text show where its pages end; lines next to
them that come again on other pages are running headers and footers.  Words of
all other texts make the lexicon.  A word of a scanned page that the lexicon
lacks is linked to words it has by plausible glyph edits; skip-gram vectors of
the words around it choose among them.  They also tell where a word that the
lexicon has is a misread one: a glyph edit of it fits clearly better there.
Then furniture goes, words hyphenated
by the layout are joined and lines reflowed into paragraphs.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut_lineage, spread, unzipped as _unzip, zipped as _zip

HYPHENS = "-­¬‐"
#: A word is in the lexicon if so many unscanned documents have it.
LEAST_DOCUMENTS = 2
#: A word with so small a share of the documents of a word one glyph edit away counts as that word misread: about as often a page has one given glyph edit of a word.
MISREAD_SHARE = 1 / 200
#: Words a lexicon holds at most; the pages of a larger one are read in two halves, each with a lexicon of its own.
LEXICON_WORDS = 250_000
#: Halvings at most.
MOST_BITS = 30
DIMENSIONS = 32
WINDOW = 3
_BESIDE = np.array([d for d in range(-WINDOW, WINDOW + 1) if d])
#: Rounds over the counted pairs, pairs a step, least steps of a block in a round, negatives that a step shares, size of the first steps.
ROUNDS = 4
STEP_PAIRS = 4096
LEAST_STEPS = 50
NEGATIVES = 64
RATE = 0.1
#: Rows of a table of vectors that are added up together.
CHUNK_ROWS = 4096
#: Log-odds by which a glyph edit must go better with the words around than a word of the lexicon does.
LEAST_LEAD = 3.0

# Glyphs as they are misread (left) and what they may have been.
GLYPHS = {
    "é": ["e"], "è": ["e"], "ê": ["e"], "ë": ["e"], "á": ["a"], "à": ["a"], "â": ["a"], "ä": ["a"], "å": ["a"],
    "í": ["i"], "ì": ["i"], "î": ["i"], "ï": ["i"], "ó": ["o"], "ò": ["o"], "ô": ["o"], "ö": ["o"], "ø": ["o"],
    "ú": ["u"], "ù": ["u"], "ü": ["u"], "ñ": ["n"], "ç": ["c"], "!": ["l", "i"], "|": ["l", "i"], "(": ["c"], "ﬁ": ["fi"], "ﬂ": ["fl"], "0": ["o"],
    "1": ["l", "i"], "5": ["s"], "6": ["b"], "8": ["b"], "9": ["g"], "3": ["e"], "2": ["z"], "7": ["t"], "vv": ["w"],
    "rn": ["m"], "nn": ["m"], "in": ["m"], "m": ["rn", "nn", "in"], "li": ["h"], "cl": ["d"], "d": ["cl"], "ri": ["n"], "ii": ["u", "n"],
    "iii": ["m"], "c": ["e", "o"], "e": ["c", "o"], "o": ["c", "e"], "f": ["t"], "t": ["f"], "l": ["i", "t"],
    "i": ["l", "j"], "j": ["i"], "u": ["n", "ll"], "n": ["u", "ri"], "h": ["b", "li"], "b": ["h"], "w": ["vv"], "q": ["g"], "g": ["q"],
}
DIGITS = str.maketrans("OoQDlI|!iSsBZzgqbGTAé", "000011111558229966740")

_NUMBER_LINE = re.compile(
    r"^\s*[\[(—–-]?\s*(?:page|seite|página|pagina|pág\.?|p\.|s\.|第)?\s*(\d{1,4})\s*(?:(?:of|von|de|/)\s*\d{1,4})?\s*页?\s*[\])—–-]?\s*$", re.I
)
_ROMAN_LINE = re.compile(r"^\s*[\[(—–-]?\s*([ivxl]{1,7})\s*[\])—–-]?\s*$")
_NUMERIC = re.compile(r"\s*[\d.,]+\s*")
_DIGITS = re.compile(r"\d+")
_NUMBER_LAST = re.compile(r"^\s*(\S.{2,70}?)\s{2,}(\d{1,4})\s*$")
_NUMBER_FIRST = re.compile(r"^\s*(\d{1,4})\s{2,}(\S.{2,70}?)\s*$")
_WORD = re.compile(r"[^\W_]+(?:[!|(](?=[^\W\d_])[^\W_]+)*")


#: Characters and bytes of plain text, of which all but letters, digits and the ends of lines become blanks.
_KEPT = np.array([c if chr(c).isalnum() or c == 10 else 32 for c in range(1 << 16)], "<u4")
_KEPT_BYTES = bytes(_KEPT[:128].tolist()) + bytes(128)
#: Characters whose words are told apart in one go.
COUNT_CHARACTERS = 4_000_000
_EDGES = re.compile(r"(?<![^\s(\"'])[!|(][a-zà-ÿ]{2,}(?:[!|(][a-zà-ÿ]+)*|[a-zà-ÿ]{2,}\((?=[\s.,;:?]|$)")
#: The second word of a compound with the hyphen before it.
_SECOND = re.compile(r"-[^\W\d_]{2,}(?![\w-])")
#: Stretches of encoded data, and what their letters make at least one word of.
_DATA = re.compile(r"[A-Za-z0-9+/]{60,}")
LONG_WORD = 24
_BROKEN = re.compile(rf"([^\W_](?:[^\W_]|[!|])*)([{HYPHENS}])[ \t\r]*$")
#: Identifiers, whose letters are spelt by no dictionary; one may end its line after the hyphen.
_IDENTIFIER = re.compile(r"(?<![^\W_])[^\W\d_]+-(?:\d+(?![^\W_])|[ \t\r]*$)")
#: A plain hyphen at a line's end before a letter.
_PERHAPS_BROKEN = re.compile(r"-[ \t\r]*\n\s*[^\W\d_]")
_GOES_ON = re.compile(r"\s*([^\W_](?:[^\W_]|[!|])*)")


def _tail(line: str) -> re.Match | None:
    """What _BROKEN finds in a line, looked for from its end."""
    end = len(line.rstrip(" \t\r")) - 1
    if end < 1 or line[end] not in HYPHENS:
        return None
    first = end
    while first and (line[first - 1].isalnum() or line[first - 1] in "!|"):
        first -= 1
    while first < end and line[first] in "!|":
        first += 1
    return _BROKEN.match(line, first)


def _chain(found: list[tuple[int, int]], least_gap: int) -> list[int]:
    """Longest run of lines whose numbers go up by one, each at least ``least_gap`` lines after the last."""
    best: dict[int, tuple[int, int, int]] = {}  # number -> (length, line, position of the entry before)
    entries: list[tuple[int, int, int]] = []
    for line, number in found:
        before = best.get(number - 1)
        length, back = (before[0] + 1, before[2]) if before and line - before[1] >= least_gap else (1, -1)
        entries.append((length, line, back))
        if number not in best or best[number][0] <= length:
            best[number] = (length, line, len(entries) - 1)
    if not entries:
        return []
    at = max(range(len(entries)), key=lambda i: entries[i][0])
    out = []
    while at >= 0:
        out.append(entries[at][1])
        at = entries[at][2]
    return out[::-1]


def _roman(text: str) -> int:
    """Value of a number in small roman digits."""
    values = [{"i": 1, "v": 5, "x": 10, "l": 50}[c] for c in text]
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))


def _laid_out(lines: list[str]) -> bool:
    """Whether words are broken at line ends as layout does it: with a special hyphen, or often."""
    soft = hard = 0
    for a, b in zip(lines, lines[1:], strict=False):
        a = a.rstrip()
        if len(a) > 2 and a[-1] in HYPHENS and a[-2].isalpha():
            if a[-1] != "-":
                soft += 1
            elif a[-2].islower() and b.lstrip()[:1].islower():
                hard += 1
    return soft > 0 or (hard >= 3 and hard >= 0.03 * len(lines))


def _alike(a: str, b: str) -> bool:
    a, b = a.strip().casefold(), b.strip().casefold()
    return a == b or _nearly(a, b)


@lru_cache(maxsize=50_000)
def _nearly(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 0.25 * max(len(a), len(b)):
        return False
    if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 0.1 * len(a):
        return True
    x, y = _letters(a), _letters(b)
    both = x.keys() & y.keys()
    if len(both) < 0.6 * min(len(x), len(y)) or sum(map(min, map(x.get, both), map(y.get, both))) < 0.4 * (len(a) + len(b)):
        return False
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.8


@lru_cache(maxsize=20_000)
def _letters(text: str) -> dict[str, int]:
    return Counter(text)


def furniture(lines: list[str], laid_out: Callable[[], bool]) -> set[int]:
    """Numbers (from 0) of running headers, footers and page numbers; empty if the text shows none.

    They are found by page numbers that count up or, where words are broken at
    line ends (``laid_out`` tells), by titles that come again.
    """
    plain: dict[str, list[tuple[int, int]]] = {}
    beside: list[tuple[int, int]] = []
    column: set[int] = set()
    numeric = lambda x: len(x) < 24 and bool(_NUMERIC.fullmatch(x))
    for i, line in enumerate(lines):
        if len(line) < 12 and (m := _ROMAN_LINE.match(line)):
            plain.setdefault(re.sub(r"[ivxl]+", "roman", line.strip()), []).append((i, _roman(m[1])))
            continue
        if not line or len(line) > 90 or not (line[0] in " \t" or line.rstrip()[-1:].isdigit() or line[0].isdigit() or len(line) < 24):
            continue  # page numbers stand at an end of their line
        if not _DIGITS.search(line):
            continue
        m = _NUMBER_LINE.match(line) if len(line.strip()) < 24 else None
        if m:
            style = re.sub(r"\d+", "#", line.strip())
            if style == "#" and (i and numeric(lines[i - 1]) or i + 1 < len(lines) and numeric(lines[i + 1])):
                column.add(i)  # perhaps only a column of numbers
            plain.setdefault(style, []).append((i, int(m[1])))
            continue
        m = _NUMBER_LAST.match(line)
        if m and m[1][0] not in "-*#|•":
            beside.append((i, int(m[2])))
            continue
        m = _NUMBER_FIRST.match(line)
        if m:
            beside.append((i, int(m[1])))
    chains = [_chain(beside, 4), *(_chain(v, 4) for v in plain.values())]
    if column and not (any(len(c) >= 3 and column & set(c) for c in chains) and laid_out()):
        plain["#"] = [x for x in plain["#"] if x[0] not in column]
        chains = [_chain(beside, 4), *(_chain(v, 4) for v in plain.values())]
    chains = [c for c in chains if len(c) >= 2]
    filled = [i for i, x in enumerate(lines) if x.strip()]
    if not chains:
        ends = {filled[0], filled[-1]} if filled else set()
        one = [i for s, v in plain.items() if s != "#" for i, n in v if n < 2000 and (laid_out() or (i in ends and s != "roman"))]
        if len(filled) < 4 or not (one or laid_out()):
            return set()
        if one:  # a single page: a decorated page number at its very end or start
            chains = [one[:1]]
    out = {i for c in chains for i in c}
    styles = [_DIGITS.sub("#", lines[c[0]]).strip() for c in chains]
    longest = max(map(len, styles), default=-8) * 1.4 + 8
    for i in filled:
        if i not in out and len(lines[i].strip()) <= longest:
            own = _DIGITS.sub("#", lines[i]).strip()
            read = _DIGITS.sub("#", lines[i].translate(DIGITS)).strip()
            if any(s != "#" and (read == s or len(own) > 3 and any(c.isalpha() for c in s) and _alike(own, s)) for s in styles):
                out.add(i)
    # what stands next to a page number or at the ends of the text, and comes again there
    rank = {line: k for k, line in enumerate(filled)}
    sides: set[int] = {filled[0], filled[-1]}
    for i in list(out):
        for step in (-1, 1):
            k = rank[i] + step
            while 0 <= k < len(filled) and filled[k] in out:
                k += step
            if 0 <= k < len(filled):
                sides.add(filled[k])
    if not chains:
        sides |= {i for i in filled if _looks_like_title(lines, i) or _in_parts(lines[i])}
    candidates = sorted(i for i in sides if i not in out and len(lines[i].strip()) <= 80)
    groups: dict[str, list[int]] = {}  # by the first line of a group
    group_of: dict[str, list[int]] = {}
    for i in candidates:
        own = lines[i].strip().casefold()
        if own not in group_of:
            low, high = 0.75 * len(own), len(own) / 0.75 + 1
            group_of[own] = next((g for head, g in groups.items() if low <= len(head) <= high and _nearly(head, own)), None) or groups.setdefault(own, [])
        group_of[own].append(i)
    for g in groups.values():
        i = g[0]
        edge = i == filled[0] or not lines[i - 1].strip() or (i + 1 < len(lines) and not lines[i + 1].strip()) or i - 1 in out or i + 1 in out
        if len(g) >= 2 or ((edge or not chains) and _looks_like_title(lines, i)):
            out.update(g)
    return out


def _in_parts(line: str) -> bool:
    """Whether a line has a few parts set apart by bars, as headers do and rows of tables, which have bars at their ends, don't."""
    line = line.strip()
    return 1 <= line.count("|") <= 3 and "|" not in (line[0], line[-1])


def _looks_like_title(lines: list[str], i: int) -> bool:
    words = lines[i].split()
    return 1 < len(words) <= 6 and len(lines[i]) < 48 and not lines[i].rstrip().endswith((".", ",", ";", ":", "?", "!", "-")) and words[0][:1].isupper() and words[-1][:1].isupper() and all(w.isalpha() for w in words[1:-1])


def scanned(text: str) -> list[int] | None:
    """Numbers (from 0) of the furniture's lines if a text looks as if it came from scanned pages: with furniture, or with words broken by layout."""
    lines = text.split("\n")
    if len(lines) < 4:
        return None
    laid_out = cache(lambda: _laid_out(lines))
    gone = furniture(lines, laid_out)
    return sorted(gone) if gone or laid_out() else None


def _spaced(text: str) -> bytes:
    """A text in UTF-8 whose words, as _WORD finds them, have blanks and ends of lines between them only."""
    inner = []  # marks within words
    for mark in "(|!":
        i = text.find(mark, 1)
        while 0 < i < len(text) - 1:
            if text[i - 1].isalnum() and text[i + 1].isalnum() and not text[i + 1].isdecimal():
                inner.append(i)
            i = text.find(mark, i + 1)
    if text.isascii():
        out = bytearray(text.encode().translate(_KEPT_BYTES))
        for i in inner:
            out[i] = ord(text[i])
        return bytes(out)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kept = _KEPT.take(codes, mode="clip")
    for i in [*inner, *(i for i in np.flatnonzero(codes >= len(_KEPT)).tolist() if text[i].isalnum())]:
        kept[i] = codes[i]
    return kept.tobytes().decode("utf-32-le").encode()


def tokens(low: str) -> list[str]:
    """Words of a lower-case text, as _WORD finds them."""
    return _spaced(low).decode().split()


def _numbered(texts: list[str]) -> Iterator[tuple[list[str], list[str], np.ndarray, np.ndarray]]:
    """Words of texts in lower case, some texts after the others: these texts, the distinct words, the number among them of every word, the number of words by text."""
    begin, held = 0, 0
    for end, text in enumerate(texts, 1):
        held += len(text)
        if held >= COUNT_CHARACTERS or end == len(texts):
            data = np.frombuffer(b"\r".join(_spaced(t.lower()) for t in texts[begin:end]), np.uint8)
            inside = np.zeros(len(data) + 2, bool)
            np.greater(data, 32, out=inside[1:-1])
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            first, size = edges[::2], edges[1::2] - edges[::2]
            offsets = np.zeros(len(first) + 1, np.int32)
            np.cumsum(size, out=offsets[1:])
            found = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[inside[1:-1]])).dictionary_encode()
            limits = np.r_[0, np.searchsorted(first, np.flatnonzero(data == 13)), len(first)]
            yield texts[begin:end], found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.diff(limits)
            begin, held = end, 0


def _undata(m: re.Match) -> str:
    """Blank for encoded data, which has digits and letters of both cases; a long path or rule stays."""
    x = m[0]
    return " " if not x.islower() and not x.isupper() and any(map(str.isdigit, x)) and any(map(str.isupper, x)) else x


def words_of(text: str) -> set[str]:
    """Words of a text as the lexicon counts them, with the compounds spelt with a hyphen. Encoded data has no words."""
    low = text.lower()
    out = set(tokens(low))
    if max(map(len, out), default=0) > LONG_WORD and (bare := _DATA.sub(_undata, text)) != text:
        low = bare.lower()
        out = set(tokens(low))
    return out | _compounds(low)


def _compounds(low: str) -> set[str]:
    """Compounds spelt with a hyphen: two words of letters, at least two each, that nothing else is joined to."""
    out = set()
    for m in _SECOND.finditer(low):
        first = hyphen = m.start()
        while first and low[first - 1].isalnum() and not low[first - 1].isdecimal():
            first -= 1
        if hyphen - first >= 2 and not (first and (low[first - 1].isalnum() or low[first - 1] in "_-")):
            out.add(low[first : m.end()])
    return out


def _count_words(counts: Counter[str], texts: list[str]) -> None:
    """Add for each word, as :func:`words_of` finds them, how many of the texts have it; numbers are left out."""
    for part, words, number, sizes in _numbered(texts):
        text = np.repeat(np.arange(len(sizes)), sizes)
        long = np.fromiter(map(len, words), np.int64, len(words)) > LONG_WORD
        apart = np.zeros(len(sizes), bool)  # texts with encoded data
        for i in np.unique(text[long[number]]).tolist():
            apart[i] = _DATA.sub(_undata, part[i]) != part[i]
        for t, own in zip(part, apart.tolist(), strict=True):
            if own or "-" in t:
                counts.update((w for w in words_of(t) if not _is_number(w)) if own else _compounds(t.lower()))
        key = np.sort((text * len(words) + number)[~apart[text]])
        times = np.bincount(key[_starts(key)] % max(1, len(words)), minlength=len(words))
        for w, n in zip(words, times.tolist(), strict=True):
            if n and not _is_number(w):
                counts[w] += n


def _is_number(word: str) -> bool:
    """Whether a word is a number, which is right as it is and in no lexicon."""
    return word.isdigit() and word.isascii()


def edits(word: str, lexicon, depth: int = 1) -> list[tuple[str, int]]:
    """(word of the lexicon, position of its first edit) reached by one plausible glyph edit, else (up to ``depth``) by more."""
    layer, seen = {word: -1}, {word}
    for _ in range(depth):
        following: dict[str, int] = {}
        for w, at in layer.items():
            for i in range(len(w)):
                for size in (1, 2, 3):
                    for true in GLYPHS.get(w[i : i + size], ()) if i + size <= len(w) else ():
                        new = w[:i] + true + w[i + size :]
                        if new not in seen:
                            seen.add(new)
                            following[new] = at if 0 <= at < i else i
        hits = [(w, at) for w, at in following.items() if w in lexicon]
        if hits:
            return hits
        layer = following
        if len(word) < 4:
            break
    return []


def _starts(at: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    change = np.empty(len(at), bool)
    change[:1] = True
    np.not_equal(at[1:], at[:-1], out=change[1:])
    return np.flatnonzero(change)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``np.add.reduceat(values, first, axis=0)``, to the last bit; that takes long over many short runs, so these are added up by length."""
    size = np.diff(first, append=len(values))
    out = values[first]
    for n in (2, 3, 4):
        run = np.flatnonzero(size == n)
        at = first[run]
        rest = values[at + 1]
        for k in range(2, n):
            rest += values[at + k]
        out[run] += rest
    run = np.flatnonzero(size > 4)
    if len(run):
        out[run] = np.add.reduceat(values, np.stack([first[run], first[run] + size[run]], 1).ravel()[: -1 if first[run[-1]] + size[run[-1]] == len(values) else None], axis=0)[::2]
    return out


def _step(rows: np.ndarray, squares: np.ndarray, row: np.ndarray, total: np.ndarray) -> None:
    """Move rows along the sums of their gradients, by less the more they have moved already."""
    far = squares[row] + (total * total).mean(1)
    squares[row] = far
    rows[row] += RATE * total / np.sqrt(far)[:, None]


class Training:
    """State of skip-gram training with negative sampling: a word's own vectors, those of words around, and how far each has moved."""

    def __init__(self, totals: np.ndarray, mean_weight: float, seed: int = 3):
        n = len(totals)
        self.inner = ((np.random.default_rng(seed).random((n, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
        self.outer = np.zeros((n, DIMENSIONS), np.float32)
        self.squares = np.full((2, n), 1e-8, np.float32)
        noise = np.maximum(totals, 1) ** 0.75
        self.noise = np.cumsum(noise / noise.sum())
        self.mean_weight = mean_weight

    def over(self, block: int, turn: int, centre: np.ndarray, other: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of both kinds and their movement after training once over the pairs of one block. A pair weighs as the root of its count."""
        rng = np.random.default_rng([block, turn])
        inner, outer, squares = self.inner.copy(), self.outer.copy(), self.squares.copy()
        mixed = np.tile(rng.permutation(len(centre)), max(1, round(LEAST_STEPS * STEP_PAIRS / max(len(centre), STEP_PAIRS))))
        weight = (np.sqrt(counts) / self.mean_weight).astype(np.float32)
        step = min(STEP_PAIRS, len(centre))
        for at in range(0, len(mixed), step):
            pick = np.sort(mixed[at : at + step])  # pairs lie by centre
            a, b, w = centre[pick], other[pick], weight[pick][:, None]
            away = np.minimum(np.searchsorted(self.noise, rng.random(NEGATIVES)), len(outer) - 1)
            x, y, z = inner[a], outer[b], outer[away]
            g = w / (1 + np.exp(np.clip(np.einsum("ij,ij->i", x, y), -15, 15)))[:, None]
            # negatives meet each centre once, as if each of its pairs had four of its own
            first = _starts(a)
            mine, own = np.add.reduceat(w, first, axis=0), x[first]
            h = (-4 / NEGATIVES) * mine / (1 + np.exp(-np.clip(own @ z.T, -15, 15)))
            move = _sums(g * y, first) + h @ z
            moved = np.concatenate([b, away])
            order = np.argsort(moved, kind="stable")
            moved = moved[order]
            starts = _starts(moved)
            _step(outer, squares[1], moved[starts], _sums(np.concatenate([g * x, h.T @ own])[order], starts))
            _step(inner, squares[0], a[first], move)
        return inner, outer, squares


class Vectors:
    """Trained vectors of words: their own and those they have as words around."""

    def __init__(self, words: list[str], inner: np.ndarray, outer: np.ndarray):
        self.number = {w: i for i, w in enumerate(words)}
        self.inner, self.outer = inner, outer

    def fit(self, word: str, around: list[str]) -> float:
        """How well a word goes with those around it: the mean log-odds of its skip-grams."""
        i = self.number.get(word)
        near = [self.number[w] for w in around if w in self.number]
        return float((self.outer[near] @ self.inner[i]).mean()) if i is not None and near else 0.0

    @cached_property
    def padded(self) -> np.ndarray:
        """Vectors of words around; the last one, at -1, stands for words that have none."""
        return np.concatenate([self.outer, np.zeros((1, DIMENSIONS), np.float32)])

    @cached_property
    def most(self) -> float:
        """Length of the longest vector of a word around."""
        return float(np.linalg.norm(self.outer, axis=1).max(initial=0))


def _around(line: str, m: re.Match) -> list[str]:
    """Words next to one of a line."""
    return [w.lower() for w in _WORD.findall(line[: m.start()])[-WINDOW:] + _WORD.findall(line[m.end() :])[:WINDOW]]


class _Memo(dict):
    """Results of a function of a word, kept up to a number."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, word: str):
        if len(self) > 200_000:
            self.clear()
        out = self[word] = self.function(word)
        return out


class Reader:
    """Finds hyphens, misread words and their corrections on scanned pages."""

    def __init__(self, lexicon: dict[str, int], vectors: Vectors):
        self.lexicon, self.vectors = lexicon, vectors
        self._known: dict[str, list[tuple[str, int]] | None] = {}
        self._right, self._single, self._codes = _Memo(self._is_right), _Memo(self._is_single), _Memo(self._code_of)
        self._rivals: dict[str, tuple[list[tuple[str, int]], np.ndarray, np.ndarray] | None] = {}

    def _is_right(self, word: str) -> bool:
        return self.readings(word) is None

    def _is_single(self, word: str) -> bool:
        return self.rivals(word.lower()) is None

    def _code_of(self, word: str) -> int:
        """Four times the number of a word's vector, plus 2 if it is not as it should be and 1 if no glyph edit may fit better."""
        return 4 * self.vectors.number.get(word.lower(), -1) + 2 * (not self._is_right(word)) + self._is_single(word)

    def codes(self, words: list[list[str]]) -> np.ndarray:
        """Codes of the words of all lines."""
        flat = list(chain.from_iterable(words))
        return np.fromiter(map(self._codes.__getitem__, flat), np.int64, len(flat))

    def readings(self, word: str) -> list[tuple[str, int]] | None:
        """None if the word is as it should be, else what it may have been (perhaps nothing known) with the edit's position."""
        if word in self._known:
            return self._known[word]
        low = word.lower()
        if low in self.lexicon or word.isdigit() and word.isascii():
            out = None
        else:
            out = edits(low, self.lexicon)
            digits = sum(c.isdigit() for c in word)
            if digits:
                number = word.translate(DIGITS)
                if number.isdigit() and digits * 2 >= len(word):
                    out = [(number, next(i for i, c in enumerate(word) if not c.isdigit()))]
                elif not out:
                    out = [("", next(i for i, c in enumerate(word) if c.isdigit()))]
            elif not out:
                odd = [i for i, c in enumerate(low) if c in "!|"]
                out = [("", odd[0])] if odd else None
        if len(self._known) > 200_000:
            self._known.clear()
        self._known[word] = out
        return out

    def rivals(self, word: str) -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray] | None:
        """Words one glyph edit away from a word of the lexicon; the differences of their vectors and of their frequency."""
        if word in self._rivals:
            return self._rivals[word]
        out, number, inner = None, self.vectors.number, self.vectors.inner
        i = number.get(word)
        found = [r for r in edits(word, self.lexicon) if r[0] in number] if i is not None and word in self.lexicon else []
        if found:
            apart = inner[[number[r[0]] for r in found]] - inner[i]
            prior = np.log([(1 + self.lexicon[r[0]]) / (1 + self.lexicon[word]) for r in found])
            # what no words around could make fit clearly better need not be tried
            can = np.linalg.norm(apart, axis=1) * self.vectors.most * 2 * WINDOW + prior >= LEAST_LEAD
            if can.any():
                out = [r for r, c in zip(found, can, strict=True) if c], apart[can], prior[can]
        if len(self._rivals) > 200_000:
            self._rivals.clear()
        self._rivals[word] = out
        return out

    def misfits(self, words: list[list[str]], codes: np.ndarray | None = None) -> list[dict[int, list[tuple[str, int]]]]:
        """For the words of each line, by place: those one glyph edit away from a word of the lexicon that fit clearly better there."""
        out: list[dict[int, list[tuple[str, int]]]] = [{} for _ in words]
        codes = self.codes(words) if codes is None else codes
        tried = np.flatnonzero(~codes & 1)
        if not len(tried):
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        line = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) + WINDOW * (line + 1)  # a gap between lines
        at = np.full(len(codes) + WINDOW * (len(words) + 1), -1)
        at[place] = codes >> 2
        start = np.cumsum(sizes) - sizes
        of = line[tried]
        inside = tried - start[of]
        rivals = [self.rivals(words[i][k].lower()) for i, k in zip(of.tolist(), inside.tolist(), strict=True)]
        n = np.fromiter((len(r[0]) for r in rivals), np.int64, len(rivals))
        near = self.vectors.padded[at[place[tried][:, None] + _BESIDE]].sum(1)
        lead = np.einsum("ij,ij->i", np.concatenate([r[1] for r in rivals]), np.repeat(near, n, axis=0))
        better = (lead > 0) & (lead + np.concatenate([r[2] for r in rivals]) >= LEAST_LEAD)
        first = np.cumsum(n) - n
        for k in np.unique(np.repeat(np.arange(len(tried)), n)[better]).tolist():
            out[of[k]][int(inside[k])] = [r for r, ok in zip(rivals[k][0], better[first[k] : first[k] + n[k]], strict=True) if ok]
        return out

    def edge(self, word: str) -> bool:
        """Whether a mark at a word's start or end is a misread letter: without it there is no such word, or it is no bracket."""
        bare = word.strip("!|(").lower()
        return bare not in self.lexicon and (word[0] in "!|" or bool(edits(word.lower(), self.lexicon)))

    def best(self, word: str, choices: list[tuple[str, int]], around: list[str]) -> str:
        """The most plausible reading in its context, in the letter case of the word."""
        choices = [c for c in choices if c[0]]
        if not choices:
            return word
        top = max(choices, key=lambda c: (math.log(1 + self.lexicon.get(c[0], 0)) + self.vectors.fit(c[0], around), c[0]))[0]
        return top.upper() if word.isupper() and len(word) > 1 else top[:1].upper() + top[1:] if word[:1].isupper() else top

    def joined(self, first: str, hyphen: str, second: str) -> bool:
        """Whether layout put the hyphen between the parts of a word."""
        if not second[:1].isalpha() or not first[-1:].isalpha() and first[-1:] not in "!|0156":
            return False
        if second[:1].isupper() and not first.isupper():
            return False
        if hyphen != "-":  # words are spelt with a plain one
            return True
        low = f"{first}-{second}".lower()
        apart = self.lexicon.get(low, 0)
        whole = self.lexicon.get((first + second).lower(), 0)
        if not apart and not whole:
            repaired = [f"{a}-{b}" for a in self._forms(first) for b in self._forms(second)]
            apart = max(self.lexicon.get(r, 0) for r in repaired)
            if apart:
                whole = len(edits((first + second).lower(), self.lexicon))
        return whole >= apart

    def _forms(self, part: str) -> list[str]:
        low = part.lower()
        return [low, *(low[:i] + t + low[i + n :] for i in range(len(low)) for n in (1, 2) for t in GLYPHS.get(low[i : i + n], ()))]

    def scanned(self, text: str) -> list[int] | None:
        """As :func:`scanned`, also where only the lexicon tells that a word is broken by layout: it has the whole, and not as a compound."""
        found = scanned(text)
        return self.broken(text) if found is None and _PERHAPS_BROKEN.search(text) else found

    def broken(self, text: str) -> list[int] | None:
        """Numbers (from 0) of the furniture's lines if a word at a line's end is broken by layout as the lexicon has it."""
        lines = text.split("\n")
        for a, b in zip(lines, lines[1:], strict=False) if len(lines) >= 4 else ():
            tail = _tail(a) if a.rstrip()[-1:] == "-" else None
            head = _GOES_ON.match(b) if tail and tail[1][-1].islower() else None
            if head and head[1][0].islower():
                apart, whole = (self.lexicon.get(f"{tail[1]}{h}{head[1]}".lower(), 0) for h in ("-", ""))
                if whole * MISREAD_SHARE > apart:
                    return sorted(furniture(lines, lambda: True))
        return None

    def lines(self, text: str, furniture_lines: list[int], kinds_only: bool = True) -> tuple[list[tuple[int, str]], list[str], set[int], dict[int, bool]]:
        """((line from 1, kind), corrected lines, furniture, which lines end in a layout hyphen)."""
        lines = text.split("\n")
        gone = set(furniture_lines)
        found = [(i + 1, "furniture") for i in sorted(gone)]
        body = [i for i in range(len(lines)) if i not in gone and lines[i].strip()]
        fixed, hyphen = list(lines), {}
        # layout uses one kind of hyphen in a text: where that is a special one, plain ones belong to the words
        special = any(lines[i].rstrip()[-1:] in HYPHENS[1:] for i in body)
        bad: set[int] = set()
        skip: dict[int, int] = {}  # characters at a line's start that belong to the line before
        right = self._right.__getitem__
        rows = _spaced(text).decode().split("\n")
        words = [rows[i].split() for i in body]
        codes = self.codes(words)
        misfits = self.misfits(words, codes)
        odd = {int(k) for k in np.repeat(np.arange(len(words)), [len(w) for w in words])[codes & 2 > 0]}  # lines with words that are not as they should be
        for k, i in enumerate(body):
            line = lines[i]
            tail = _tail(line)
            end, word_end = len(line), None
            if tail and k + 1 < len(body):
                nxt = body[k + 1]
                head = _GOES_ON.match(lines[nxt])
                if head:
                    end = tail.start()
                    if (tail[2] != "-" or not special) and self.joined(tail[1], tail[2], head[1]):
                        hyphen[i] = True
                        found.append((i + 1, "hyphen"))
                        skip[nxt] = head.end()
                        whole = tail[1] + head[1]
                        choices = self.readings(whole)
                        if choices is None:
                            before = _WORD.findall(line[: tail.start()])
                            choices = None if self._single[whole] else self.misfits([[*before, whole, *_WORD.findall(lines[nxt][head.end() :])]])[0].get(len(before))
                        if choices:
                            bad.add(i if choices[0][1] < len(tail[1]) else nxt)
                            if not kinds_only:
                                word_end = (tail[1] + head[1], choices, nxt, head)
                    else:
                        end = len(line)
            start = skip.get(i, 0)
            wrong = []
            if misfits[k] or (k in odd if not start and end == len(line) else not all(map(right, _WORD.findall(line, start, end)))):
                skipped = len(_WORD.findall(line, 0, start)) if start else 0
                for place, m in enumerate(_WORD.finditer(line, start, end), skipped):
                    choices = self.readings(m[0])
                    if choices is None:
                        choices = misfits[k].get(place)
                    if choices is not None:
                        wrong.append((m, choices))
            if "!" in line or "|" in line or "(" in line:
                for m in _EDGES.finditer(line, start, end):
                    if self.edge(m[0]) and (choices := self.readings(m[0])) is not None:
                        wrong.append((m, choices))
            if wrong:
                named = [m.span() for m in _IDENTIFIER.finditer(line)]
                wrong = [w for w in wrong if not any(a <= w[0].start() and w[0].end() <= b for a, b in named)]
            if wrong:
                bad.add(i)
            if not kinds_only:
                for m, choices in sorted(wrong, key=lambda w: -w[0].start()):
                    fixed[i] = fixed[i][: m.start()] + self.best(m[0], choices, _around(line, m)) + fixed[i][m.end() :]
                if word_end:
                    whole, choices, _, _ = word_end
                    new = self.best(whole, choices, [w.lower() for w in _WORD.findall(line[: tail.start()])[-WINDOW:]])
                    cut = min(len(tail[1]), len(new))
                    lead = fixed[i].rstrip()
                    fixed[i] = lead[: len(lead) - len(tail[0].rstrip())] + new[:cut] + tail[2]
                    nxt, head = word_end[2], word_end[3]
                    lines[nxt] = lines[nxt][: head.start(1)] + new[cut:] + lines[nxt][head.end() :]
                    fixed[nxt] = lines[nxt]
                    words[k + 1] = _WORD.findall(lines[nxt])
                    misfits[k + 1] = self.misfits([words[k + 1]])[0]
                    odd.add(k + 1)
                    skip[nxt] = head.start(1) + len(new) - cut
        found += [(i + 1, "misread") for i in sorted(bad)]
        return found, fixed, gone, hyphen

    def repair(self, text: str) -> str:
        """The text as continuous paragraphs; a text that is not from scanned pages stays as it is."""
        furniture_lines = self.scanned(text)
        if furniture_lines is None:
            return text
        _, fixed, gone, hyphen = self.lines(text, furniture_lines, kinds_only=False)
        paragraphs: list[str] = []
        current, open_word, blank = "", False, False
        for i, line in enumerate(fixed):
            if i in gone:
                continue
            if not line.strip():
                blank = True
                continue
            words = line.strip()
            indented = line[:2] == "  "
            # a blank line ends a paragraph only after a full stop: page breaks leave blank lines within sentences
            ended = current.rstrip().endswith((".", "!", "?", ":", "。", "！", "？"))
            if current and (blank and ended or indented and ended) and not open_word:
                paragraphs.append(current)
                current = ""
            current += ("" if open_word or not current or re.search(r"\w-$", current) else " ") + words
            open_word = i in hyphen
            if open_word:
                current = current.rstrip()[:-1]
            blank = False
        return "\n\n".join([*paragraphs, current] if current else paragraphs)


def _read(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over all texts: ``id, text, furniture`` of those from scanned pages, ``word, n`` counted in the others.

    Others of which a word may be broken by layout are there too, with null for
    furniture: the lexicon decides.  Words are counted by task here.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    rows = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL"))
    names = ["id", "text", "furniture", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        id_type = None

        def counted() -> pa.RecordBatch:
            k = len(counts)
            arrays = [pa.nulls(k, id_type), pa.nulls(k, pa.string()), pa.nulls(k, pa.list_(pa.int32())), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            id_type = b.column(0).type
            take, lines, others = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = scanned(t) if "\n" in t else None
                if found is not None:
                    take.append(i), lines.append(found)
                elif t:
                    others.append(t)
                    if _PERHAPS_BROKEN.search(t):
                        take.append(i), lines.append(None)
            _count_words(counts, others)
            at = pa.array(take, pa.int64())
            k = len(take)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(lines, pa.list_(pa.int32())), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], names=names)
            if len(counts) > 1_000_000:  # added up after the shuffle
                yield counted()
        if counts:
            yield counted()

    return cut_lineage(rows.mapInArrow(run, f"id {kind}, text string, furniture array<int>, word string, n long"))


def sought(text: str, furniture_lines: list[int] | None) -> set[str]:
    """Words of a scanned text, with those its line ends may make, whose glyph edits a Reader looks up."""
    gone = set(furniture_lines or ())
    lines = [x for i, x in enumerate(text.lower().split("\n")) if i not in gone and x.strip()]
    body = "\n".join(lines)
    out = set(tokens(body))
    for line in lines:
        if "(" in line or "|" in line or "!" in line:
            for m in _EDGES.finditer(line):
                out |= {m[0], m[0].strip("!|(")}
    for line, after in zip(lines, lines[1:], strict=False):
        if (tail := _tail(line)) and (head := _GOES_ON.match(after)):
            out |= {tail[1], head[1], tail[1] + head[1]}
    return out


class _All:
    """Stands for a lexicon that has every word."""

    def __contains__(self, word: str) -> bool:
        return True


def _lexicon(read: DataFrame, pages: DataFrame) -> DataFrame:
    """``word, n``: words of unscanned documents with the number of such documents: those on the pages or one glyph edit from a word there.

    A compound is there if both its parts are.  Candidates travel as hashes; a
    collision only lets one more word in.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[str] = set()
        for b in batches:
            for t, gone in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out |= sought(t, gone)
            if len(out) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string())], names=["word"])
                out.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string())], names=["word"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        every = _All()
        for b in batches:
            out: set[int] = set()
            for w in b.column(0).to_pylist():
                if not (w.isdigit() and w.isascii()):  # a number is right as it is
                    out.add(xxh64_intdigest(w, 42))
                    out.update(xxh64_intdigest(e, 42) for e, _ in edits(w, every))
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(out, np.uint64, len(out)).view(np.int64))], names=["h"])

    asked = pages.select("text", "furniture").mapInArrow(words, "word string").distinct().mapInArrow(near, "h long").distinct()
    counted = read.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    rows = counted.where(~F.col("word").rlike("^[0-9]+$|[ﬀ-ﬆ]")).withColumn("parts", F.split("word", "-"))
    # xxhash64 has the seed 42 that near() uses
    parts = rows.select("word", "n", F.size("parts").alias("k"), F.explode("parts").alias("part")).withColumn("h", F.xxhash64("part"))
    return parts.join(asked, "h", "left_semi").groupBy("word", "n").agg(F.count("*").alias("there"), F.max("k").alias("k")).where("there = k").select("word", "n")


def trusted(lexicon: dict[str, int]) -> dict[str, int]:
    """The lexicon without words that are rather a much more frequent word misread, in scanned texts that were not seen to be.

    It goes by shares, so that the more documents there are the misread words
    do not come to count as known.
    """
    most = max(lexicon.values(), default=0) * MISREAD_SHARE
    return {w: n for w, n in lexicon.items() if n >= most or not any(lexicon[r] * MISREAD_SHARE > n for r, _ in edits(w, lexicon))}


class _Unknown(dict):
    """Numbers of words; -1 for those without."""

    def __missing__(self, word: str) -> int:
        return -1


def _pair_blocks(documents: DataFrame, text_col: str, words: list[str]) -> DataFrame:
    """``block, centre, other, counts, own, totals``: how often words stand near others in all texts, by block of the first word.

    Every pair is there in both directions; ``own`` are the block's words with their ``totals``.
    """
    size = max(1, len(words))
    spark = documents.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    texts = spread(documents.select(F.col(text_col).alias("text")).where("text IS NOT NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, held = _Unknown(number.value), [], 0

        def counted() -> pa.RecordBatch:
            k = np.sort(np.concatenate(keys))
            keys.clear()
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
            n, k = np.diff(np.r_[first, len(k)]), k[first]
            a, b = k // size, k % size
            two = a != b
            a, b, n = np.r_[a, b[two]], np.r_[b, a[two]], np.r_[n, n[two]]
            order = np.argsort((a % blocks) * size + a, kind="stable")
            a, b, n = a[order].astype(np.int32), b[order].astype(np.int32), n[order].astype(np.int32)
            block = a % blocks
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.empty(0, np.int64)
            out = [(int(block[i]), _zip(a[i:j], b[i:j], n[i:j])) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["block", "pairs"])

        for batch in batches:
            for _, found, number_of, sizes in _numbered(batch.column(0).to_pylist()):
                x = np.full(len(number_of) + WINDOW * len(sizes), -1)  # a gap between texts
                x[np.arange(len(number_of)) + WINDOW * np.repeat(np.arange(len(sizes)), sizes)] = np.fromiter(map(known.__getitem__, found), np.int64, len(found))[number_of]
                for d in range(1, WINDOW + 1):
                    one, other = x[:-d], x[d:]
                    ok = (one >= 0) & (other >= 0)
                    one, other = one[ok], other[ok]
                    keys.append(np.minimum(one, other) * size + np.maximum(one, other))
                    held += len(one)
                if held > 6_000_000:  # added up after the shuffle
                    yield counted()
                    held = 0
        if keys:
            yield counted()

    def add(table: pa.Table) -> pa.Table:
        a, b, n = (np.concatenate(x) for x in zip(*(_unzip(p, [np.int32] * 3) for p in table.column("pairs").to_pylist()), strict=True))
        key = a.astype(np.int64) * size + b
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, n = key[first], np.add.reduceat(n, first)
        centre, other = (key // size).astype(np.int32), (key % size).astype(np.int32)
        first = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]])
        own, totals = centre[first], np.add.reduceat(n, first)
        weight = float(np.sqrt(n).sum())
        return pa.table({"block": table.column("block").slice(0, 1), "pairs": pa.array([_zip(centre, other, n)], pa.binary()), "own": pa.array([_zip(own, totals)], pa.binary()), "n": pa.array([len(n)], pa.int64()), "weight": pa.array([weight])})

    return cut_lineage(texts.mapInArrow(run, "block int, pairs binary").groupBy("block").applyInArrow(add, "block int, pairs binary, own binary, n long, weight double"))


def _vectors(documents: DataFrame, text_col: str, lexicon: dict[str, int], rounds: int = ROUNDS) -> Vectors:
    """Skip-gram vectors of all words of the lexicon, from all texts.

    The pairs stay in blocks by their first word.  In a round each block is
    trained on where it lies: its words' own vectors are moved by it alone; the
    vectors of words around move by the sum of their movements in all blocks
    over the root of the number of blocks that moved them.  What comes to the driver is bounded by LEXICON_WORDS.
    """
    words = sorted(lexicon, key=lambda w: (-lexicon[w], w))
    spark = documents.sparkSession
    pairs = _pair_blocks(documents, text_col, words)
    totals, met, weight = np.zeros(len(words)), 0, 0.0
    for r in pairs.select("own", "n", "weight").collect():
        own, n = _unzip(r[0], [np.int32, np.int64])
        totals[own] = n
        met, weight = met + r[1], weight + r[2]
    state = Training(totals, weight / max(met, 1))
    n = len(words)
    kind = "kind int, chunk int, at binary, data binary, n binary"
    for turn in range(rounds if met else 0):
        shared = spark.sparkContext.broadcast(state)

        def train(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            moved, squares, touched, any_block = np.zeros((n, DIMENSIONS), np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32), False
            for batch in batches:
                for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    before, any_block = shared.value, True
                    centre, other, counts = _unzip(data, [np.int32, np.int32, np.int64])
                    inner, outer, far = before.over(block, turn, centre, other, counts)
                    outer -= before.outer
                    moved += outer
                    squares += far[1] - before.squares[1]
                    touched += outer.any(1)
                    own = np.unique(centre)
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([block], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([inner[own].tobytes()], pa.binary()), pa.array([far[0][own].tobytes()], pa.binary())], names=["kind", "chunk", "at", "data", "n"])
            if any_block:
                for c, low in enumerate(range(0, n, CHUNK_ROWS)):
                    part = slice(low, low + CHUNK_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([c], pa.int32()), pa.array([squares[part].tobytes()], pa.binary()), pa.array([moved[part].tobytes()], pa.binary()), pa.array([touched[part].tobytes()], pa.binary())], names=["kind", "chunk", "at", "data", "n"])

        def added(table: pa.Table) -> pa.Table:
            if table.column("kind")[0].as_py() == 0:
                return table
            sums = [sum(np.frombuffer(x, np.float32) for x in table.column(c).to_pylist()) for c in ("at", "data", "n")]
            squares, moved, touched = sums
            touched = np.sqrt(np.maximum(touched, 1))
            moved = moved.reshape(-1, DIMENSIONS) / touched[:, None]
            return pa.table({"kind": table.column("kind").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "at": pa.array([(squares / touched).tobytes()], pa.binary()), "data": pa.array([moved.tobytes()], pa.binary()), "n": pa.array([b""], pa.binary())})

        for r in pairs.select("block", "pairs").mapInArrow(train, kind).groupBy("kind", "chunk").applyInArrow(added, kind).toLocalIterator():
            if r.kind == 0:
                own = np.frombuffer(r.at, np.int32)
                state.inner[own] = np.frombuffer(r.data, np.float32).reshape(-1, DIMENSIONS)
                state.squares[0][own] = np.frombuffer(r.n, np.float32)
            else:
                part = slice(r.chunk * CHUNK_ROWS, (r.chunk + 1) * CHUNK_ROWS)
                state.outer[part] += np.frombuffer(r.data, np.float32).reshape(-1, DIMENSIONS)
                state.squares[1][part] += np.frombuffer(r.at, np.float32)
        shared.destroy()
    return Vectors(words, state.inner, state.outer)


def _parts(documents: DataFrame, id_col: str, text_col: str) -> list[tuple[Column, DataFrame, Broadcast]]:
    """(condition on the id, scanned texts and others that may be, if they meet it, their Reader); one part unless the lexicon of all is too large."""
    spark = documents.sparkSession
    read = _read(documents, id_col, text_col)
    every = read.where("text IS NOT NULL").select("id", "text", "furniture")
    out, open_ = [], [(0, 0)]
    while open_:
        bits, value = open_.pop()
        mine = F.pmod(F.xxhash64("id"), F.lit(1 << bits)) == value if bits else F.lit(True)
        pages = every.where(mine)
        words = cut_lineage(_lexicon(read, pages))
        if words.count() > LEXICON_WORDS and bits < MOST_BITS:
            open_ += [(bits + 1, value), (bits + 1, value + (1 << bits))]
            continue
        rows = words.toArrow()
        lexicon = trusted(dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True)))
        out.append((mine, pages, spark.sparkContext.broadcast(Reader(lexicon, _vectors(documents, text_col, lexicon)))))
    return out


def noisy_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, line_no, kind`` (furniture, hyphen, misread) of the lines of texts from scanned pages.

    Texts with neither page furniture nor words broken by layout give no rows;
    null and empty texts neither.  Repeated documents give
    their rows once.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    found = None
    for _, pages, reader in _parts(documents, id_col, text_col):

        def run(batches: Iterator[pa.RecordBatch], reader=reader) -> Iterator[pa.RecordBatch]:
            for b in batches:
                take, line, kinds = [], [], []
                for i, (t, gone) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    gone = reader.value.broken(t) if gone is None else gone
                    for n, k in reader.value.lines(t, gone)[0] if gone is not None else ():
                        take.append(i), line.append(n), kinds.append(k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(take, pa.int64())), pa.array(line, pa.int32()), pa.array(kinds, pa.string())], names=["id", "line_no", "kind"]
                )

        one = spread(pages).mapInArrow(run, f"id {kind}, line_no int, kind string")
        found = one if found is None else found.unionByName(one)
    return found.distinct().withColumnRenamed("id", id_col)


def repaired_texts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text`` of every row: texts from scanned pages repaired, all others (null and empty ones too) as they are."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    result = None
    for mine, _, reader in _parts(documents, id_col, text_col):

        def run(batches: Iterator[pa.RecordBatch], reader=reader) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [reader.value.repair(t) if t else t for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

        one = rows.where(mine).mapInArrow(run, f"id {kind}, text string")
        result = one if result is None else result.unionByName(one)
    return result.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)
