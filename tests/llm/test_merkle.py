"""The manifest against a tree that is built node by node."""

import zlib
from hashlib import sha256

import pytest

from redressa.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, position string, leaf int"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_over(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain(rows):
    languages = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in languages:
        own = sorted(
            (r for r in rows if r[2] == name), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))
        )
        trees.append((own, levels_over([leaf(r, r[1]) for r in own])))
    top = levels_over([levels[-1][0] for _, levels in trees])
    found = []
    for number, (own, levels) in enumerate(trees):
        for at, row in enumerate(own):
            text = row[1]
            if text and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node, siblings = leaf(row, text), ""
            for tree, place in ((levels, at), (top, number)):
                for level in tree[:-1]:
                    run, i = level[place // 8 * 8 : place // 8 * 8 + 8], place % 8
                    siblings += "".join(run[:i] + run[i + 1 :])
                    node = digest("".join(run[:i] + [node] + run[i + 1 :]))
                    place //= 8
            root = top[-1][0]
            found.append((row[0], levels[0][at], levels[-1][0], root, digest(siblings), node, node == root))
    return found


def rows_of(found):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_equals_plain_tree_for_every_block_size(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    sizes = {"en": 530, "de": 65, "fr": 64, "éa": 9, "zz": 8, "it": 1, None: 3}
    rows, number = [], 7
    for lang, size in sizes.items():
        for _ in range(size):
            number += 3
            rows.append((number, f"Text Number {number} É", lang, "S" if number % 2 else None, number, "x", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(docs)
    assert rows_of(found) == sorted(plain(rows), key=str)


def test_odd_rows(spark):
    rows = [
        (None, "A", "en", None, 1, "", 1),
        (None, None, "en", None, None, "", 1),
        (0, "A" * 300_000, "en", "s", 1, "", 1),
        (5, "", "", "s", 0, "", 1),
        (6, None, None, "s", None, "", 1),
        (-4, "B c", "en", "", -7, "", 1),
    ]
    rows += [(12, "Same", "en", "s", 4, "", 1)] * 20 + [(12, "Other", "en", "s", 5, "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(merkle.manifest(docs)) == sorted(plain(rows), key=str)
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.filter("doc_id = 5")).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.siblings == ""


def test_versions_copy_only_the_nodes_over_the_leaf(spark):
    rows = [(i, "Abc", "en", "s", 3, "", 1) for i in range(600)]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    changed = [r for r in found if r.copied is not None]
    assert len(changed) == sum(zlib.crc32(str(i).encode()) % 3 == 0 for i in range(600))
    # 600 leaves have four levels over them; one language adds none.
    assert {len(r.copied) for r in changed} == {4}
    assert all(r.copied[-1] == r.folded_root != r.root and not r.verified for r in changed)
    assert all(r.verified and r.folded_root == r.root for r in found if r.copied is None)


def test_any_change_can_be_tampering(spark):
    rows = [(i, "Abc", "en", "s", 3, "", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(docs, tamper=lambda doc_id, text: text)
    assert all(r.verified and r.copied is None for r in found.collect())
