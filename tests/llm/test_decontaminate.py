"""Benchmark search against exact containment of every pair."""

import random
import re

from redressa.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain(docs, items):
    found = {}
    for item_id, text in set(items):
        w = words(text)
        if not w:
            continue
        k = min(5, len(w))
        wanted = shingles(w, k)
        for doc_id, body in docs:
            shared = len(wanted & shingles(words(body), k))
            if 100 * shared >= 80 * len(wanted):
                best = found.get((doc_id, item_id), (0, 0, 0))
                found[doc_id, item_id] = max(best, (shared / len(wanted), len(wanted), shared))
    return found


def test_finds_all_and_only_contained_items(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 60)))) for i in range(40)]
    items += [(90, "Two words"), (91, ""), (92, None), (93, "one"), (None, "a null id has words too here")]
    docs = []
    for d in range(120):
        body = rng.choices(vocabulary, k=rng.randint(0, 300))
        if d % 2:
            planted = words(items[rng.randrange(40)][1])
            for _ in range(rng.randint(0, 3)):
                planted[rng.randrange(len(planted))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = planted
        docs.append((d, ", ".join(body).title()))
    docs += [(200, "here are TWO-words, and One."), (201, None), (202, ""), (None, "A null id has words, too, here!")]
    docs += [(203, items[0][1]), (203, items[0][1]), (203, items[1][1])]
    got = decontaminate.find_items(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in got} == {
        k: (n, s) for k, (_, n, s) in plain(docs, items).items()
    }


def test_keeps_clean_rows_and_takes_empty_tables(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame(
        [(1, "x " * 9000 + item + " y" * 9000, "a"), (2, "clean", "b"), (None, item, "c"), (None, "clean", "d")],
        "doc_id long, text string, item_id string",
    )
    items = spark.createDataFrame([(7, item), (7, item), (7, "other words of it")], "item_id long, text string")
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.item_id for r in kept.collect()) == ["b"]
    assert decontaminate.keep_clean(docs, items.limit(0)).count() == 4
    assert decontaminate.find_items(docs.limit(0), items).count() == 0


def test_sketch_is_one_longer_than_what_may_be_missing(spark):
    text = " ".join(f"w{i}" for i in range(59))
    rows = decontaminate.item_shingles(spark.createDataFrame([(1, text)], "item_id long, text string")).collect()
    assert len(rows) == 55 and sum(r.sketch for r in rows) >= 12
