"""Line dedup against marks made by comparing every block with the earlier ones."""

import random

from redressa.llm import line_dedup


def plain(rows, min_words):
    """Kept text of each (doc_id, text) row; rows in reading order."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = set(), {}
    for row in order:
        lines = row[1].split("\n")
        for at in range(len(lines)):
            # All earlier starts are in ``seen`` with every length.
            for end in range(at + 1, len(lines) + 1):
                if tuple(lines[at:end]) in seen and sum(len(x.split()) for x in lines[at:end]) >= min_words:
                    gone.setdefault(row, set()).update(range(at, end))
            seen.update(tuple(lines[at:end]) for end in range(at + 1, len(lines) + 1))
    return {
        r: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone.get(r, ()))
        for r in order
    }


def test_maximal_runs_whose_halves_come_from_different_documents(spark):
    a, b, c = ("one two three four", "five six seven eight", "nine ten eleven twelve")
    texts = [f"{a}\n{b}", f"{b}\n{c}", f"{a}\n{b}\n{c}", f"{a}\n{b}\n{c}", f"x\n{a}\n{b}\n{c}\n\ny", f"{c}\n\ny\n{a}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, 10).collect()}
    assert [got[i].n_removed for i in range(6)] == [0, 0, 0, 3, 3, 0]
    assert got[3].text == "" and got[4].text == "x\n\ny"


def test_many_blank_lines(spark):
    blank = "\n" * 700
    texts = [f"a b c{blank}d e f", f"a b c{blank}d e f", f"z{blank}", blank]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, 5).collect()}
    assert got == {0: texts[0], 1: "", 2: texts[2], 3: texts[3]}


def test_random_lines_equal_plain_marks(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "c c c", "", "d"]) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(500, rows[3][1] + "\nnew\n" + rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 4):
        got = {(r.doc_id): r.text for r in line_dedup.line_dedup(docs, least).collect()}
        assert got == {k[0]: v for k, v in plain(rows, least).items()}


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None, 1, "p"), (2, "", 2, "q"), (3, "a b c d e f g h i j k", 3, "r"), (4, "a b c d e f g h i j k", 4, "s")]
    rows += [(None, "a b c d e f g h i j k\nz", 5, "t"), (5, "x", 6, "u"), (5, "x", 7, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, gone string")
    got = {r.gone: r for r in line_dedup.line_dedup(docs, 10).collect()}
    assert len(got) == len(rows)
    assert got["p"].text is None and got["p"]._n_lines == 0 and got["p"].n_lines == 1
    assert got["q"].text == "" and got["q"]._n_lines == 1
    assert got["r"].text == got["s"].text == ""  # the null doc_id is first
    assert got["t"].text.endswith("\nz") and got["u"].text == got["v"].text == "x"
    kept = line_dedup.keep_new_lines(docs, 10)
    assert kept.columns == docs.columns
    assert {r.gone for r in kept.collect()} == {"p", "q", "t", "u", "v"}
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_a_copy_goes_whole_with_its_short_lines(spark):
    text = "a line of more than ten words is here for the run\nshort\nend"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "short\nother")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, 10).collect()}
    assert got == {1: text, 2: "", 3: "short\nother"}


def test_long_repeats_need_log_rounds_and_a_common_line_is_fine(spark):
    run = "\n".join(f"line number {i}" for i in range(300))
    rows = [(i, "the same old line here\n" * 5 + f"own {i}") for i in range(400)] + [(900, run), (901, "x\n" + run + "\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, 10).collect()}
    assert got[901].text == "x\ny" and got[901].n_removed == 300
    assert got[900].n_removed == 0
    assert got[399].text == "own 399"
