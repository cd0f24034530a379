"""Packing: exact round trip of tokens, capacities, and few bins."""

import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from redressa.llm import packing
from redressa.llm.queries import QUERIES

RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=1)
def tokenizer():
    found = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    found.encode_special_tokens = True
    return found


def tokenizers_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_are_those_of_the_tokenizers_file(text):
    assert packing.encoder(RANKS).encode_ordinary(text) == tokenizers_ids(text)


def test_pieces_and_places_are_exact(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (None, "no id"), (-3, "<|endoftext|> is text"), (-4, "word " * 5000), (-5, "a" * 3000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, piece int")
    got = packing.pack_documents(docs, shard=64).collect()
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(rows)
    for doc_id, text in rows:
        ids, own = [*tokenizers_ids(text), 2], sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert own[0].start == 0 and own[-1].start + own[-1].length == len(ids)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert all(r.length == 1024 for r in own[1:])
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = random.Random(2)
    lengths = np.array(sorted((rng.randint(1, 77) for _ in range(3000)), reverse=True))
    bins, offsets = packing.best_fit(lengths, 100, 3, 6000 if rule == "dot" else 10_000, rule)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3
        assert (own**2).sum() <= 10_000
        order = np.argsort(offsets[bins == b])
        assert (np.cumsum(own[order]) - own[order] == offsets[bins == b][order]).all()


def test_too_large_a_piece_is_refused():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([200]), 100)


def test_few_bins():
    lengths = np.array(sorted((random.Random(4).choices(range(1, 1024), k=8000)), reverse=True))
    bins, _ = packing.best_fit(lengths)
    assert bins.max() + 1 <= 1.01 * lengths.sum() / 1024 + 1
    ones, _ = packing.best_fit(np.ones(5000, dtype=np.int64))
    assert ones.max() + 1 == 5


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.just("<|endoftext|>"))).map("".join))
def test_added_tokens_are_those_of_the_tokenizers_file_at_its_defaults(text):
    file = plain_tokenizer().encode(text, add_special_tokens=False).ids
    assert packing.encoder(RANKS, packing.ADDED).encode(text, allowed_special="all") == file


@lru_cache(maxsize=1)
def plain_tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_the_query_packs_added_tokens(spark, tmp_path):
    text = "a <|endoftext|> b"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = np.array([*plain_tokenizer().encode(text, add_special_tokens=False).ids, packing.END], dtype="<u4")
    got = QUERIES["op10_best_fit_packing"](spark, str(tmp_path)).collect()
    assert [(r.length, r.ids_crc32) for r in got] == [(len(ids), zlib.crc32(ids.tobytes()))]


@pytest.mark.parametrize(
    "text",
    [
        " " * 1_200_000, "\n" * 1_200_000, "a" + " \n" * 600_000 + "b", " " * 30_000 + "x", "x" + "\t" * 30_000 + " y z",
        "x" + " " * 25_000 + "<|endoftext|>" + " " * 25_000 + "'s", "\u3000" * 30_000 + "\x1c" * 30_000 + "end", " a" * 30_000,
    ],
)
def test_long_runs_of_blanks(text):
    file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoding = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), packing.ADDED)
    assert packing.token_ids(encoding, text) == file.encode(text, add_special_tokens=False).ids
