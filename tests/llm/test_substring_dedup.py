"""Content-defined chunks: cuts, shifts, planted passages and exact removal."""

import random

from redressa.llm import substring_dedup as chunked
from redressa.llm.queries import QUERIES


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(n))


def test_chunks_cover_the_text_and_never_cut_a_character():
    rng = random.Random(1)
    for text in ["", "a", "é" * 3000, prose(rng, 4000), "ab" * 5000, "日本語" * 700]:
        data = text.encode()
        ends = chunked.chunk_ends(data)
        assert ends == sorted(set(ends)) and (ends[-1:] == [len(data)] or not data)
        for a, b in zip([0, *ends], ends, strict=False):
            assert b - a <= chunked.MAX_CHUNK
            data[a:b].decode()


def test_cuts_are_the_same_in_slices(monkeypatch):
    data = prose(random.Random(2), 3000).encode()
    whole = chunked.chunk_ends(data)
    monkeypatch.setattr(chunked, "SLICE", 333)
    assert chunked.chunk_ends(data) == whole


def test_cuts_come_again_after_an_insertion():
    rng = random.Random(3)
    for _ in range(200):
        passage = prose(rng, 60)
        one, two = prose(rng, 30) + " " + passage, prose(rng, 41) + " " + passage
        own = [
            {t.encode()[a:b] for a, b in zip([0, *e], e, strict=False)}
            for t in (one, two)
            for e in [chunked.chunk_ends(t.encode())]
        ]
        assert sum(map(len, own[0] & own[1])) >= chunked.MIN_RUN


def test_planted_passages_go_and_clean_documents_stay(spark):
    rng = random.Random(4)
    passages = [prose(rng, 55) for _ in range(12)]
    rows, planted = [], set()
    for d in range(240):
        words = prose(rng, 120).split()
        if d % 3 == 0:
            words[50:50] = passages[d // 3 % 12].split()
            planted.add(d)
        rows.append((d, " ".join(words), d))
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    got = chunked.substring_dedup(docs)
    assert got.columns == [*docs.columns, "n_removed", "_spans", "first_doc_ids"]
    got = {r.doc_id: r for r in got.collect()}
    first = {min(d for d in planted if d // 3 % 12 == k) for k in range(12)}
    for d, text, _ in rows:
        r = got[d]
        if d in planted - first:
            assert r.n_removed > 128 and set(r.first_doc_ids) & first
            keep, at = [], 0
            for a, b in r._spans:
                keep.append(text[at:a])
                at = b
            assert "".join([*keep, text[at:]]) == r.text
        else:
            assert r.text == text and r.n_removed == 0
    changed = chunked.substring_dedup(docs, changed_only=True)
    assert {r.doc_id for r in changed.collect()} == planted - first


def test_odd_rows(spark):
    long = prose(random.Random(5), 30_000).replace("e", "é日")
    rows = [(1, None, 0), (2, "", 0), (3, "short", 0), (4, "short", 0), (None, long, 0), (5, long, 0), (6, long, 0), (6, long, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cuts2 int")
    got = chunked.substring_dedup(docs).collect()
    assert len(got) == len(rows)
    texts = {r.doc_id: r.text for r in got}
    assert texts[1] is None and texts[2] == "" and texts[3] == texts[4] == "short"
    assert texts[None] == long and texts[5] == texts[6] == ""
    assert chunked.substring_dedup(docs.limit(0)).count() == 0


def test_the_query_returns_every_document(spark, tmp_path):
    long = prose(random.Random(6), 300)
    rows = [(1, long), (2, "own words"), (3, long), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op6_substring_dedup"](spark, str(tmp_path)).collect()}
    assert {d: r.n_removed for d, r in got.items()} == {1: 0, 2: 0, 3: len(long), 4: 0, 5: 0}
    assert got[1].text == long and got[3].text == "" and got[4].text is None and got[2].spans == ""


def test_clashing_names_of_helper_columns(spark):
    passage = "a passage that is long enough to be found in two documents, word for word, and then some more of it " * 3
    rows = [(i, f"{i} before. {passage} after {i}", "p", "q", "r", "s") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cuts string, _first string, _id string, _hash string")
    got = sorted(chunked.substring_dedup(docs).collect())
    assert [tuple(r[2:6]) for r in got] == [("p", "q", "r", "s")] * 3
    assert got[0].n_removed == 0 and all(r.n_removed > 100 for r in got[1:])
