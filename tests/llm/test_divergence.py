"""Divergences against plain counting with Python's whole numbers."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from redressa.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, shard int"


def words_of(text):
    word, words = "", []
    for c in text + " ":
        if "A" <= c <= "Z":
            c = c.lower()
        if "a" <= c <= "z" or ord(c) > 127:
            word += c
        elif word:
            words.append(word)
            word = ""
    return words


def plain(rows, min_docs, top):
    uses, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = words_of(text or "")
        uses[lang, source].update(words)
        docs[lang].update(set(words))
    found = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        counts = {s: [uses[lang, s][t] for t in kept] for s in sources}
        whole = [sum(c[i] for c in counts.values()) for i in range(len(kept))]

        def shares(count, v=len(kept)):
            return [1 + 10**9 * (c + 5) // (sum(count) + 5 * v) for c in count]

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in sources:
            pairs = [(-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s]
            own = [
                (q[i] - p[s][i], t.encode())
                for i, t in enumerate(kept)
                if counts[s][i] and p[s][i] > q[i]
            ]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                for rank, (value, item) in enumerate(sorted(items)[:most], 1):
                    found.add((lang, s, part, item.decode(), -value, rank))
    return found


def got(docs, **options):
    rows = divergence.divergences(docs, **options)
    assert rows.columns == ["lang", "source", "part", "item", "value", "rank"]
    return [tuple(r) for r in rows.collect()]


def some_rows(n=400):
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "délta", "Éta", "ΑΒγ", "日本", "x", "don't", "e-mail", "12ab34", "ß", "\x7f", "🙂"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", "Z", None])
        text = " ".join(rng.choices(words, [rng.random() + (len(source or "") * 0.1) for _ in words], k=rng.randint(0, 30)))
        rows.append((i, rng.choice([text, text, text, None, "", " .,\n"]), lang, source, "t", 1, 2))
    return rows


@pytest.mark.parametrize(("cells", "held", "size"), [(1 << 20, 400_000, 4 << 20), (7, 50, 200)])
def test_equals_plain_counts(spark, monkeypatch, cells, held, size):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "SLICE", size)
    rows = some_rows()
    found = got(spark.createDataFrame(rows, SCHEMA), min_docs=5, top=3)
    assert len(found) == len(set(found)) and set(found) == plain(rows, 5, 3)


def test_odd_tables(spark):
    rows = [(1, None, None, None, "", 0, 0), (1, None, None, None, "", 0, 0), (2, "a b", "en", "s", "", 0, 0)]
    rows += [(3, "x", "en", "t", "", 0, 0), (4, "word " * 200_000, "en", "s", "", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    # No term is in 30 documents.
    assert set(got(docs)) == {("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)}
    assert set(got(docs, min_docs=1)) == plain(rows, 1, 50)
    assert got(docs.limit(0)) == []


def test_shares_of_counts_beyond_what_a_product_holds():
    rng = random.Random(1)
    totals = [rng.randrange(1, 9 * 10**15) for _ in range(300)]
    counts = [rng.randrange(0, t + 1) for t in totals]
    found = divergence.share(np.array(counts), np.array(totals))
    assert found.tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals, strict=True)]
