"""SimHash groups against comparing all pairs."""

import random

import numpy as np
import pytest

from redressa.llm import simhash


def groups(values, distance=2):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_links_have_the_groups_of_all_pairs(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    for seed in list(values)[:20]:
        for _ in range(6):
            v = seed
            for _ in range(rng.randint(1, 3)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    crowd = {0xABCDEF << 40 | rng.getrandbits(9) for _ in range(200)}
    values = sorted(signed(v) for v in values | crowd)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(fps)).collect()}
    assert {v: found.get(v, v) for v in values} == groups(values)


def test_thresholds_follow_the_pigeonhole_sum():
    sample = np.array([random.Random(i).getrandbits(63) for i in range(500)], dtype=np.int64)
    for rows in (100, 10**6, 10**11):
        layout = simhash.plan_parts(sample, rows)
        assert sorted(b for bits, _ in layout for b in bits) == list(range(64))
        assert sum(t for _, t in layout) == 2 - len(layout) + 1
    assert len(simhash.plan_parts(np.array([], dtype=np.int64), 0)) >= 1


def test_fingerprint_of_odd_texts():
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n\t") == 0
    assert simhash.fingerprint("A b") == simhash.fingerprint("a\tB ")
    assert simhash.fingerprint("É") != simhash.fingerprint("é")  # only A-Z is lowered
    long = "one two three four five " * 30_000
    assert simhash.fingerprint(long) == simhash.fingerprint(long.upper())


def test_rows_groups_and_kept_rows(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(9, text, "a"), (4, text, "b"), (7, text + " more", "c"), (1, None, "d"), (2, "", "e"), (None, "lone text", "f")]
    rows += [(3, "quite another text", "g"), (3, "quite another text", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(9, 4), (4, 4), (1, 1), (2, 1), (3, 3), (None, None)} <= got
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert {"b", "d", "f", "g", "h"} <= {r.fp for r in kept.collect()}
    assert "a" not in {r.fp for r in kept.collect()}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_crowds_are_only_resolved_for_two_bits(spark):
    with pytest.raises(ValueError):
        simhash._stars(spark.range(1).toDF("fp"), 3)
