"""Personal data: base spans against the patterns as written, and disguises."""

import hashlib
import re

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redressa.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), order, (kind, *m.span())))
    return [s for *_, s in sorted(found)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1290.@+- ()-%é４o\n", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.plain_spans(text) == plain(text)


def test_base_spans_of_whole_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    assert all(pii.plain_spans(r.text) == plain(r.text) for r in rows)
    assert sum(len(pii.plain_spans(r.text)) for r in rows) > 20


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("mail bob.smith [at] example (dot) com now", "email", "bob.smith [at] example (dot) com"),
        ("jo dot doe at host dot org", "email", "jo dot doe at host dot org"),
        ("x@y dot com", "email", "x@y dot com"),
        ("to bob@ехаmрle.com", "email", "bob@ехаmрle.com"),
        ("at １９２.168.0.1 now", "ip", "１９２.168.0.1"),
        ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("plus one five five five one two three four five six", "phone", "plus one five five five one two three four five six"),
        ("four one one one " + "one " * 12 + "end", "card", "four one one one " + ("one " * 12).strip()),
        ("no. 4lll-1111-1111-1111", "card", "4lll-1111-1111-1111"),
        ("double four one one one one one one one one one one one one one nine", "card", None),
    ],
)
def test_disguises_are_found_at_their_source(text, kind, hidden):
    spans = pii.hidden_spans(text, pii.plain_spans(text))
    assert [(k, text[a:b]) for k, a, b in spans] == ([(kind, hidden)] if hidden else [])


@pytest.mark.parametrize(
    "text",
    ["look at example.com", "the at of dot and", "one two three", "meet at the dot", "Oh, one or two", "été à 12 h 30", "Привет мир"],
)
def test_plain_prose_has_no_hidden_span(text):
    assert pii.hidden_spans(text, pii.plain_spans(text)) == []


def test_tape_maps_back():
    tape = pii.Tape("abcdef", [(1, 3, "X"), (4, 5, "")])
    assert tape.text == "aXdf"
    assert tape.back(1, 2) == (1, 3, True) and tape.back(2, 4) == (3, 6, False)


def test_odd_rows(spark):
    long = "word " * 200_000 + "a@b.co " + "7" * 100_000
    rows = [(1, None, 0), (2, "", 0), (None, "a@b.co", 0), (3, "a@b.co", 0), (3, "a@b.co", 0), (4, long, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    got = pii.personal_data(docs).collect()
    assert sorted(r.n_email for r in got) == [0, 0, 1, 1, 1, 1]
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in got if r.doc_id in (1, 2)} == {empty}
    assert {r.spans for r in got if r.doc_id == 3} == {"email:0:6"}
    assert pii.personal_data(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("kind", "hidden"),
    [
        ("ip", "192 dot 168 dot 0 dot 1"),
        ("ip", "192.168.one.5"),
        ("phone", "+1 415 555 26 seven 1"),
        ("phone", "plus 1 415 555 2671"),
        ("phone", "+four,one,five,five,five,one,two,three,four,five"),
    ],
)
def test_digit_runs_do_not_hang_on_other_words(kind, hidden):
    for text in (hidden, f"call {hidden} now", f"a-b {hidden} or else one"):
        at = text.index(hidden)
        assert pii.hidden_spans(text, pii.plain_spans(text)) == [(kind, at, at + len(hidden))]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["one", "Dot", "plus", "double", "7", "19", " ", ",", "-", ".", "+", "x", "é", "ſix"]), max_size=14).map("".join))
def test_the_cue_is_in_every_run_that_is_rewritten(text):
    for m in pii._DIGIT_RUN.finditer(text):
        assert pii._CUE.search(text) or not any(c.isalpha() for c in m[0])


@pytest.mark.parametrize(
    ("text", "hidden"),
    [
        ("user [at] mail [dot] ru", "user [at] mail [dot] ru"),
        ("user (at) firma (dot) it now", "user (at) firma (dot) it"),
        ("user at mail [dot] nl", "user at mail [dot] nl"),
        ("x@ab dot xyz", "x@ab dot xyz"),
        ("bob [at] mail dot co dot uk", "bob [at] mail dot co dot uk"),
        ("bob (at) host.ai point taken", "bob (at) host.ai"),
        ("john dot q dot public at host dot com", "john dot q dot public at host dot com"),
        ("meet at the dot cafe", None),
        ("look at firma.it now", None),
    ],
)
def test_addresses_of_any_domain_and_name(text, hidden):
    spans = pii.hidden_spans(text, pii.plain_spans(text))
    assert [text[a:b] for _, a, b in spans] == ([hidden] if hidden else [])


@pytest.mark.parametrize("dot", [" dot ", " [dot] ", "(.)", "."])
def test_long_names_are_read_back_to_their_beginning(dot):
    name = dot.join(["part"] * 400)
    text = f"write to {name} at host dot com today"
    (span,) = pii.hidden_spans(text, [])
    assert span == ("email", 9, len(text) - len(" today"))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("bob AT firma DOT it", "bob AT firma DOT it"),
        ("user at example dot ru", "user at example dot ru"),
        ("user at mail dot example dot nl", "user at mail dot example dot nl"),
        ("look at this dot it is red", None),
        ("aim at each dot in the row", None),
        ("we met at noon dot and left", None),
        ("a point at this point it ends", None),
    ],
)
def test_spoken_addresses_of_any_ending(text, found):
    spans = [text[a:b] for kind, a, b in pii.hidden_spans(text, []) if kind == "email"]
    assert spans == ([found] if found else [])


def test_long_hostile_texts_take_linear_time():
    for part in ("a at ", "a dot ", "x [dot] ", "a   ", "at dot "):
        started = time.perf_counter()
        pii.hidden_spans(part * (400_000 // len(part)), [])
        assert time.perf_counter() - started < 20
