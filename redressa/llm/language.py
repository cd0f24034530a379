"""Language of texts by script ranges, word scores and Viterbi.

Learning. Character n-grams (one to four, with word ends marked) are counted by language
into hashed buckets, on at most ``SAMPLE`` documents of each language (the bound on the sample), whole
texts. What reaches the driver is ``languages x buckets`` counts, whatever the corpus, and the shares of
scripts in each language.

Prediction. Each word's script leaves only the languages that write it; the word's score
in each of them is its n-grams' log-likelihood. Viterbi over the words, with a penalty for
each switch, labels the text in spans; the prediction is the language with most letters.
A text where no stretch could pay for a switch is settled by sums alone, which gives the
same labels; others run the recursion.

Scale: prediction is one scan without shuffle. Inside a task, texts are taken in slices of
bounded length for scoring, so memory follows the longest text's word count, at a few
bytes a word.

Defined results: null and letterless texts are ``und`` with score 0, and so is everything if
there is nothing to learn from. Rows without lang or doc_id teach nothing. Ties go to the first language in
order. Repeated rows are predicted alike; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.llm.common import map_rows
from redressa.session import materialize

UNKNOWN = "und"
SAMPLE = 1000
SALTS = 50
BROADCAST_ROWS = 1_000_000
BUCKETS = 1 << 15
LONGEST = 4
SMOOTHING = 0.1
SWITCH = 25.0
SCRIPT_SHARE = 0.001
SLICE = 1_000_000

# First code point of each script range; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"),
    (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "other"), (0x20000, "han"),
)
_STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_OF_RANGE = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages, log-likelihood
    writes: np.ndarray  # scripts x languages, bool


def _words(text: str) -> list[str]:
    """Lower-case words; one of number characters only (½, Ⅷ) is none."""
    found = _WORD.findall(text.lower())
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with a mark at both ends; word of each; first letters."""
    joined = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), dtype="<u4")
    word = np.cumsum(joined == 2) - 1
    return joined.astype(np.uint64), word, joined[1:][joined[:-1] == 2]


def _grams(codes: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) of all n-grams, one length at a time."""
    value = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        value = value[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        inside = word[:m] == word[n - 1 :]
        mixed = value[inside]
        yield ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(
            BUCKETS
        ), word[:m][inside]


def _scripts(first: np.ndarray) -> np.ndarray:
    return _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, first, side="right") - 1]


# ---- learning ---------------------------------------------------------------------------


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id's text, modulo 3."""
    return F.crc32(doc_id.cast("string")) % 3


def _sample(docs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` documents of each language: the smallest hashes of each of
    ``SALTS`` equal parts, so that a language with most of the rows is not one group."""
    usable = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 1))
    salts = min(SALTS, most)
    salt = F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(salts))
    order = Window.partitionBy("lang", "salt").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        usable.select("doc_id", "lang", salt.alias("salt"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= most // salts)
        .select("doc_id")
        .distinct()
    )
    ids = materialize(ids, "sample")
    # Then no text is shuffled for the sample; with very many languages it is.
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return usable.select("doc_id", "lang", "text").join(ids, "doc_id", "left_semi")


def learn(docs: DataFrame, most: int = SAMPLE) -> Model:
    """The model of ``docs`` (``doc_id``, ``text``, ``lang``) outside the held-out fold."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                totals = np.zeros(BUCKETS, dtype=np.int64)
                scripts = np.zeros(len(SCRIPT_NAMES), dtype=np.int64)
                for words in _slices(text or ""):
                    codes, word, first = _codes(words)
                    for bucket, _ in _grams(codes, word):
                        totals += np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
                    scripts += np.bincount(_scripts(first), minlength=len(scripts))
                for kind, values in ((0, totals), (1, scripts)):
                    at = np.flatnonzero(values)
                    yield pd.DataFrame({"lang": lang, "kind": kind, "at": at, "n": values[at]})

    counted = (
        _sample(docs, most)
        .select("lang", "text")
        .mapInPandas(count, "lang string, kind int, at int, n long")
        .groupBy("lang", "kind", "at")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(counted["lang"].unique())
    grams = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    for k, language in enumerate(languages):
        own = counted[counted["lang"] == language]
        for kind, to in ((0, grams), (1, scripts)):
            some = own[own["kind"] == kind]
            to[some["at"].to_numpy(dtype=int), k] = some["n"]
    grams += SMOOTHING
    writes = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    writes &= scripts > 0
    writes[~writes.any(axis=1)] = True  # a script nobody writes excludes nobody
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), writes)


# ---- prediction -------------------------------------------------------------------------


def _slices(text: str) -> Iterator[list[str]]:
    """Lower-case words of the whole text, some at a time, none cut."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text):
            cut = _WORD.search(text, end - 1)
            end = cut.end() if cut and cut.start() <= end - 1 else end
        words = _words(text[at:end])
        if words:
            yield words
        at = end


def _word_scores(words: list[str], model: Model) -> np.ndarray:
    """words x languages; each distinct word is scored once."""
    place, distinct = pd.factorize(np.array(words, dtype=object))
    codes, word, first = _codes(list(distinct))
    scores = np.zeros((len(distinct), len(model.languages)), dtype=np.float32)
    for bucket, owner in _grams(codes, word):
        if len(owner) == 0:
            continue  # all words are shorter
        values = model.scores[bucket.astype(np.int64)]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        scores[owner[starts]] += np.add.reduceat(values, starts, axis=0)
    scores -= scores.max(axis=1, keepdims=True)
    return np.where(model.writes[_scripts(first)], scores, scores.min() - SWITCH)[place]


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word: sum of scores less ``switch`` for each change."""
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    if len(scores) == 0 or scores.shape[1] == 1:
        return np.full(len(scores), best)
    # What leaving the best constant path for any stretch could gain at most: the largest
    # sum over a stretch of (best other language - best language).
    others = np.delete(scores, best, axis=1).max(axis=1)
    gain = np.cumsum(np.r_[0.0, (others - scores[:, best]).astype(np.float64)])
    if (gain - np.minimum.accumulate(gain)).max() <= switch:
        return np.full(len(scores), best)
    rows = scores.astype(np.float64).tolist()
    value, back = rows[0], []
    for row in rows[1:]:
        top = max(range(len(value)), key=value.__getitem__)
        hop = value[top] - switch
        came = [k if v >= hop else top for k, v in enumerate(value)]
        value = [max(v, hop) + s for v, s in zip(value, row, strict=True)]
        back.append(came)
    label = max(range(len(value)), key=value.__getitem__)
    labels = [label]
    for came in reversed(back):
        label = came[label]
        labels.append(label)
    return np.array(labels[::-1])


def label_text(text: str | None, model: Model) -> tuple[str, float, list[tuple[str, int, int]]]:
    """Language, its share of the letters, and (language, first word, word after) spans."""
    scores, letters = [], []
    for words in _slices(text or "") if model.languages else ():
        scores.append(_word_scores(words, model))
        letters.append(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    if not scores:
        return UNKNOWN, 0.0, []
    return _summary(np.concatenate(scores), np.concatenate(letters), model)


def _summary(scores: np.ndarray, letters: np.ndarray, model: Model):
    labels = viterbi(scores)
    share = np.bincount(labels, weights=letters, minlength=len(model.languages))
    top = int(share.argmax())
    turns = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    ends = [*turns[1:].tolist(), len(labels)]
    spans = [(model.languages[labels[a]], a, b) for a, b in zip(turns.tolist(), ends, strict=True)]
    return model.languages[top], float(share[top] / share.sum()), spans


def _label_many(texts: list[str | None], model: Model) -> Iterator[tuple]:
    """Like ``label_text`` of each; short texts share one scoring."""
    group: list[list[str]] = []
    size = 0

    def settle() -> Iterator[tuple]:
        scores = _word_scores([w for words in group for w in words], model) if size else None
        at = 0
        for words in group:
            if not words:
                yield UNKNOWN, 0.0, []
                continue
            letters = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            yield _summary(scores[at : at + len(words)], letters, model)
            at += len(words)

    for text in texts:
        if text and len(text) > SLICE:
            yield from settle()
            group, size = [], 0
            yield label_text(text, model)
            continue
        group.append(_words(text) if text and model.languages else [])
        size += len(group[-1])
        if size > SLICE // 4:
            yield from settle()
            group, size = [], 0
    yield from settle()


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``spans`` (language:first word:word after)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (name, score, ",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                for name, score, spans in _label_many(batch["text"].tolist(), model)
            ]
            rows = pd.DataFrame(found, columns=["lang_pred", "score", "spans"])
            rows.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield rows

    schema = "lang_pred string, score double, spans string"
    return map_rows(docs.select("doc_id", "text"), "doc_id", run, schema)
