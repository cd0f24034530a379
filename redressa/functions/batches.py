"""Measures and words of many texts at once, on arrays of their characters.

The values are those of the column expressions of ``text``, for steps whose rows are written anyway: one pass over the
characters in place of some dozen patterns. Texts are joined by line breaks in chunks of ``CHUNK`` characters (a longer one is
a chunk of its own); runs of letters and digits are then found where the class of a character changes.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Workers need not have this package installed: its code travels with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 21
CHUNK_TEXTS = 2048
# Cells of the table of some texts and all words that tells distinct ones.
TABLE = 1 << 22

_LETTER, _DIGIT, _UPPER, _WORD = 1, 2, 4, 8
# All others are lower-cased to texts without new ASCII characters.
_LOWERED = {"İ": "i̇", "K": "k"}
_MONEY = re.compile(r"\{\$[0-9,]+(?:\.[0-9]+)?\}|\$[0-9,]+")


def _class(point: int) -> int:
    character = chr(point)
    kind = unicodedata.category(character)
    found = _WORD if kind[0] in "LN" or character == "_" else 0
    found |= _DIGIT if kind == "Nd" else 0
    if character.isascii() and kind in ("Lu", "Ll"):
        found |= _LETTER | (_UPPER if kind == "Lu" else 0)
    return found


_FIRST_CLASSES = np.array([_class(p) for p in range(256)], dtype=np.uint8)


def _classes(points: np.ndarray) -> tuple[np.ndarray, bool]:
    """Classes of the characters, and whether some of ``_LOWERED`` are among them."""
    last = int(points.max())
    if last < 256:
        return _FIRST_CLASSES[points], False
    present = np.zeros(last + 1, dtype=bool)
    present[points] = True
    table = np.zeros(last + 1, dtype=np.uint8)
    table[:256] = _FIRST_CLASSES
    rare = (256 + np.flatnonzero(present[256:])).tolist()
    table[rare] = [_class(point) for point in rare]
    return table[points], any(chr(point) in _LOWERED for point in rare)


class _Characters:
    """Characters of some texts, a line break before the first and after each."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.texts, self.n = texts, len(texts)
        joined = "\n" + "\n".join(texts) + "\n"
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=self.n)
        self.edges = np.r_[1, 1 + np.cumsum(self.lengths + 1)]
        self.classes, self.odd = _classes(self.points)
        self.kind = self.classes & (_LETTER | _DIGIT)
        self.low = self.points + ((self.classes & _UPPER) << 3)
        change = np.flatnonzero(self.kind[1:] != self.kind[:-1]) + 1
        start, end = change[:-1], change[1:]
        run = self.kind[start] > 0
        self.start, self.end = start[run], end[run]

    def count(self, places: np.ndarray) -> np.ndarray:
        """How many of the sorted ``places`` each text has."""
        return np.diff(np.searchsorted(places, self.edges))

    def total(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(values)][np.searchsorted(places, self.edges)])

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, and whether it has two parts, of each word (letters, an apostrophe between) and number (a point between)."""
        start, end, kind = self.start, self.end, self.kind[self.start]
        mark = np.where(kind == _LETTER, ord("'"), ord("."))
        linked = np.zeros(len(start), dtype=bool)
        linked[:-1] = (start[1:] == end[:-1] + 1) & (kind[1:] == kind[:-1]) & (self.points[end[:-1]] == mark[:-1])
        # Of a chain of linked runs every other one begins a token, which takes the next.
        place = np.arange(len(start))
        fresh = np.r_[True, ~linked[:-1]][: len(start)]
        begins = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
        pair = linked & begins
        ends = np.where(pair, np.r_[end[1:], 0][: len(end)], end)
        return start[begins], ends[begins], pair[begins]

    def names(self, start: np.ndarray, end: np.ndarray) -> tuple[pa.DictionaryArray, str]:
        """The lower-cased tokens, none beside the next, and the encoding of their bytes."""
        inside = np.zeros(len(self.points) + 1, dtype=np.int8)
        inside[start] += 1
        inside[end] -= 1
        letters = self.low[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        plain = not len(letters) or int(letters.max()) < 128
        data = letters.astype(np.uint8) if plain else letters
        offsets = np.r_[0, np.cumsum((end - start) * data.itemsize)].astype(np.int32)
        found = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return found.dictionary_encode(), "ascii" if plain else "utf-32-le"

    def texts_of(self, places: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.count(places))


def _distinct(texts: np.ndarray, codes: np.ndarray, n: int, width: int) -> np.ndarray:
    """How many codes each of ``n`` texts has; ``texts`` are sorted."""
    found = np.zeros(n, dtype=np.int64)
    step = max(1, TABLE // width)
    for first in range(0, n, step):
        inside = slice(*np.searchsorted(texts, [first, first + step]))
        table = np.zeros(step * width, dtype=bool)
        table[(texts[inside] - first) * width + codes[inside]] = True
        found[first : first + step] = table.reshape(step, width).sum(axis=1)[: n - first]
    return found


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _is_plain_term(term: str) -> bool:
    """Whether a term can be looked for by its first three characters."""
    return len(term) >= 3 and term.isascii() and "\n" not in term and "\0" not in term


def _apart(places: np.ndarray, size: int) -> np.ndarray:
    """The hits that remain if one that overlaps the last that remained is left out."""
    if not (np.diff(places) < size).any():
        return places
    kept, free = [], 0
    for place in places.tolist():
        if place >= free:
            kept.append(place)
            free = place + size
    return np.array(kept, dtype=np.int64)


class _Terms:
    """Counts substrings of the lower-cased texts; all terms are looked for together."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.terms = sorted(set(terms))
        self.plain = [t for t in self.terms if _is_plain_term(t)]
        heads = sorted({self._head(t) for t in self.plain})
        self.number = {h: i + 1 for i, h in enumerate(heads)}
        self.heads = np.zeros(1 << 15, dtype=np.uint16)
        self.heads[heads] = np.arange(1, len(heads) + 1)

    @staticmethod
    def _head(term: str) -> int:
        a, b, c = (ord(x) & 31 for x in term[:3])
        return (a << 10) | (b << 5) | c

    def count(self, low: _Characters) -> dict[str, np.ndarray]:
        other = [t for t in self.terms if t not in set(self.plain)]
        found = {t: np.array([s.lower().count(t) for s in low.texts], dtype=np.int64) for t in other}
        # Others than ASCII are in no plain term.
        letters = np.where(low.low < 128, low.low, 0).astype(np.uint8)
        five = (letters & 31).astype(np.uint16)
        group = self.heads[(five[:-2] << 10) | (five[1:-1] << 5) | five[2:]]
        places = np.flatnonzero(group)
        group = group[places]
        order = np.argsort(group, kind="stable")
        places, bounds = places[order], np.searchsorted(group[order], np.arange(len(self.number) + 2))
        padded = np.r_[letters, np.zeros(max(map(len, self.plain), default=0), dtype=np.uint8)]
        for term in self.plain:
            number = self.number[self._head(term)]
            hits = places[bounds[number] : bounds[number + 1]]
            for at, letter in enumerate(term.encode()):
                hits = hits[padded[hits + at] == letter]
            found[term] = low.count(_apart(hits, len(term)))
        return found


def _paragraphs(points: np.ndarray) -> np.ndarray:
    """Places of the first characters of lines that are not blank."""
    places = np.flatnonzero((points == ord("\n")) | (points == ord("\r")))[:-1] + 1
    blank = (points == ord(" ")) | (points == ord("\t"))
    if blank[places].any():
        # The first character from each place that is no blank.
        seen = np.flatnonzero(~blank)
        places = seen[np.searchsorted(seen, places)]
    return places[(points[places] != ord("\n")) & (points[places] != ord("\r"))]


def _measures(texts: list[str], lexicons: Mapping[str, Sequence[str]], terms: _Terms, connectives: Sequence[str]) -> dict[str, np.ndarray]:
    raw = _Characters(texts)
    low = _lowered(raw)
    points, kinds = raw.points, raw.classes
    is_letter = raw.kind[raw.start] == _LETTER
    letters, digits = (raw.total(raw.start[k], (raw.end - raw.start)[k]) for k in (is_letter, ~is_letter))

    start, end, pair = low.tokens()
    n_words = low.count(start)
    plain = ~pair & (low.kind[start] == _LETTER)
    lengths = low.total(start[plain], (end - start)[plain])
    names, encoding = low.names(start, end)
    codes, width = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(names.dictionary))
    owner = low.texts_of(start)
    joins = pc.is_in(names.dictionary, value_set=pa.array([c.encode(encoding) for c in connectives], pa.binary()))
    joins = joins.to_numpy(zero_copy_only=False).astype(bool)

    stop = (points == ord(".")) | (points == ord("!")) | (points == ord("?"))
    n_sentences = np.maximum(raw.count(np.flatnonzero(stop[1:] & ~stop[:-1]) + 1), 1)
    n_sentences[raw.lengths == 0] = 0

    money = np.zeros(raw.n, dtype=np.int64)
    for i in np.flatnonzero(raw.count(np.flatnonzero(points == ord("$")))):
        money[i] = len(_MONEY.findall(texts[i]))
    crossed = np.flatnonzero(np.diff((points == ord("X")).view(np.int8))) + 1
    first, last = crossed[::2], crossed[1::2]
    hidden = (last - first >= 2) & (((kinds[first - 1] | kinds[last]) & _WORD) == 0)

    found = {
        "n_chars": raw.lengths,
        "n_words": n_words,
        "n_sentences": n_sentences,
        "avg_word_len": _share(lengths, low.count(start[plain])),
        "avg_sentence_len": _share(n_words, n_sentences),
        "lexical_diversity": _share(_distinct(owner, codes, raw.n, width), n_words),
        "uppercase_ratio": _share(raw.count(np.flatnonzero(kinds & _UPPER)), letters),
        "digit_count": digits,
        "money_amount_count": money,
        "redaction_count": raw.count(first[hidden]),
        "question_count": raw.count(np.flatnonzero(points == ord("?"))),
        "exclamation_count": raw.count(np.flatnonzero(points == ord("!"))),
    }
    hits = terms.count(low)
    for name, own in lexicons.items():
        found[name] = sum((hits[t] for t in own), np.zeros(raw.n, dtype=np.int64))
    found["connective_count"] = low.count(start[joins[codes]])
    found["n_paragraphs"] = raw.count(_paragraphs(points))
    return found


def _lowered(raw: _Characters) -> _Characters:
    """The characters to look for words in; mostly the same."""
    if not raw.odd:
        return raw
    table = str.maketrans(_LOWERED)
    return _Characters([t.translate(table) for t in raw.texts])


def _words(texts: list[str], stop_words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many topic words each text has, stop words left out, and these words."""
    low = _lowered(_Characters(texts))
    start, end = low.start, low.end
    free = ((low.classes[start - 1] | low.classes[end]) & _WORD) == 0
    kept = free & (low.kind[start] == _LETTER) & (end - start >= 3)
    start, end = start[kept], end[kept]
    names, _ = low.names(start, end)
    codes = names.indices.to_numpy(zero_copy_only=False)
    stops = pc.is_in(names.dictionary, value_set=stop_words).to_numpy(zero_copy_only=False).astype(bool)
    left = ~stops[codes]
    return low.count(start[left]), names.dictionary.take(pa.array(codes[left])).cast(pa.string())


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    some, size = [], 0
    for text in texts.to_pylist():
        text = text or ""
        if some and (size + len(text) > CHUNK or len(some) >= CHUNK_TEXTS):
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def measures(
    kinds: Mapping[str, pa.DataType], lexicons: Mapping[str, Iterable[str]], connectives: Sequence[str]
) -> Callable[[pa.Array], pa.Array]:
    """A function from texts to structs of the measures ``kinds``; null texts are empty."""
    lists = {name: list(own) for name, own in lexicons.items()}
    terms = _Terms(t for own in lists.values() for t in own)

    def run(texts: pa.Array) -> pa.Array:
        parts = [_measures(some, lists, terms, connectives) for some in _chunks(texts)]
        columns = [
            pa.array(np.concatenate([p[name] for p in parts]) if parts else [], pa.float64() if kind == pa.float64() else pa.int64()).cast(kind)
            for name, kind in kinds.items()
        ]
        return pa.StructArray.from_arrays(columns, list(kinds))

    return run


def topic_words(stop_words: Sequence[str]) -> Callable[[pa.Array], pa.Array]:
    """A function from texts to lists of their topic words without ``stop_words``; null texts have none."""
    stops = pa.array([w.encode() for w in stop_words], pa.binary())

    def run(texts: pa.Array) -> pa.Array:
        parts = [_words(some, stops) for some in _chunks(texts)]
        sizes = np.concatenate([np.zeros(1, dtype=np.int64), *[n for n, _ in parts]])
        words = pa.concat_arrays([w for _, w in parts]) if parts else pa.array([], pa.string())
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), words)

    return run
