"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found by four patterns (``base``). Then the text passes through
two transducers, each of which rewrites some stretches and remembers where they came from:
the first maps look-alike characters (other scripts' letters and digits, wide and styled
forms, invisible characters) to ASCII, the second spelled digits ("four one double one"),
letters that stand for digits inside numbers, and at/dot disguises ("name [at] host (dot) org").
The same patterns read the result, and what they find is mapped back to source characters.
Spans of the base stay; a span found after rewriting is added when it holds rewritten
characters and no base span of its kind overlaps it.

Offsets count code points, ends are exclusive. One document is one unit of work with time in
proportion to its length: patterns are anchored so that no stretch is read again from each of
its characters. The scan moves no text to another task.

Defined results: null is read as the empty text, without spans (checksum of the empty
string). Repeated rows and null ids are kept as they are. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_letters, digits

import pandas as pd
from pyspark.sql import DataFrame

from redressa.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---- base patterns ----------------------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that could start inside a run of digits could start before it as well, so the
# look-behind changes no result; it keeps long runs from being tried at every digit.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[Span]:
    """Each match holds one ``@``, with the longest run of local characters before it."""
    done = 0
    sign = text.find("@")
    while sign >= 0:
        start = sign
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            yield "email", start, domain.end()
            done = domain.end()
        else:
            done = max(done, start)
        sign = text.find("@", sign + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        twice = digit * 2 if place % 2 else digit
        total += twice - 9 if twice > 9 else twice
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Base spans, by start and then kind."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = (p.lstrip("0") for p in m[0].split("."))
            if all(len(p) < 3 or (len(p) == 3 and int(p) <= 255) for p in parts):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- transducers ------------------------------------------------------------------------


class Tape:
    """A rewritten text that knows the source of each of its characters."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        """``edits``: (start, end, replacement) in order and apart from each other."""
        parts, self.at, self.source, self.edited, done, length = [], [], [], [], 0, 0
        for start, end, new in [*edits, (len(source), len(source), "")]:
            for begin, stop, piece, changed in ((done, start, source[done:start], False), (start, end, new, True)):
                if piece:
                    parts.append(piece)
                    self.at.append(length)
                    self.source.append((begin, stop))
                    self.edited.append(changed)
                    length += len(piece)
            done = end
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span of the text; whether it holds a rewritten part."""
        first, last = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        begin, stop = self.source[first][0], self.source[last][1]
        if not self.edited[first]:
            begin += start - self.at[first]
        if not self.edited[last]:
            stop = self.source[last][0] + end - self.at[last]
        changed = last > first + 1 or any(self.edited[first : last + 1])
        return begin, stop, changed


# Letters of other scripts that look like these Latin ones.
_LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ",
    "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іı", "j": "ј", "l": "ӏ",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "х",
    "y": "у", ".": "․。｡", "@": "＠﹫", "-": "‐‑‒–−", "+": "⁺﹢",
}
_SAME = {other: latin for latin, others in _LOOKALIKES.items() for other in others}
# Everything past the Latin letters with marks may be a disguise.
_STRANGE = re.compile("[­²³¹ıɑ-\U0010ffff]")


@lru_cache(maxsize=65_536)
def plain_character(c: str) -> str | None:
    """What a strange character stands for: ASCII, nothing if it is invisible, or None."""
    if c in _SAME:
        return _SAME[c]
    if unicodedata.category(c) == "Cf" or "︀" <= c <= "️":
        return ""
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    if unicodedata.category(c) == "Zs":
        return " "
    form = unicodedata.normalize("NFKC", c)
    return form if form.isascii() and form.isprintable() and len(form) == 1 else None


def _characters(text: str) -> Tape | None:
    if text.isascii():
        return None
    edits = []
    for m in _STRANGE.finditer(text):
        new = plain_character(m[0])
        if new is not None:
            edits.append((m.start(), m.end(), new))
    return Tape(text, edits) if edits else None


# Words of digits in English, German, French and Spanish.
_DIGIT_WORDS = {
    0: "zero oh null zéro cero", 1: "one eins un uno", 2: "two zwei deux dos", 3: "three drei trois tres",
    4: "four vier quatre cuatro", 5: "five fünf cinq cinco", 6: "six sechs seis", 7: "seven sieben sept siete",
    8: "eight acht huit ocho", 9: "nine neun neuf nueve",
}
_VALUE = {w: str(d) for d, ws in _DIGIT_WORDS.items() for w in ws.split()}
_TIMES = {"double": 2, "triple": 3}
_DOT_WORDS = ("dot", "punkt", "punto", "point")
_LONGEST_DOT = max(map(len, _DOT_WORDS))
_PLUS_WORDS = ("plus",)


def _any(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_SPELLED = rf"(?:{_any([*_VALUE, *_TIMES])}|[0-9]+)"
# Four or more digit words or groups in a row, with separators or dots between them.
_DIGIT_RUN = re.compile(
    rf"(?<!\w)(?:(?:\+|(?:{_any(_PLUS_WORDS)})\b)[\s-]*)?{_SPELLED}\b"
    rf"(?:(?:[\s,;-]{{1,3}}(?:(?:{_any(_DOT_WORDS)})[\s-]{{1,2}})?|\.){_SPELLED}\b){{3,}}",
    re.IGNORECASE,
)
_DIGIT_TOKEN = re.compile(r"\+|\.|[0-9]+|[^\W\d]+")
# A number some of whose digits are letters that look like them.
_LETTERED = re.compile(r"(?<![\w.+-])[0-9OolI+][0-9OolI]*(?:[\x20().-]{1,2}[0-9OolI]+)*(?!\w)")
_DIGIT_LETTERS = str.maketrans("OolI", "0011")
_AT_WORDS = ("at", "arroba", "@")
_TLDS = "com|org|net|edu|gov|info|biz|io|dev|de|fr|es|uk|us|eu|ch|at|co"
_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_BRACKET_AT = rf"{_OPEN}(?:{_any(_AT_WORDS)}){_CLOSE}"
_BRACKET_DOT = rf"{_OPEN}(?:{_any([*_DOT_WORDS, '.'])}){_CLOSE}".replace("|.)", r"|\.)")
_PLAIN_DOT = rf"\s+(?:{_any(_DOT_WORDS)})\s+"
_LABEL = r"[A-Za-z0-9-]+"
_ANY_DOT = rf"(?:\.|{_BRACKET_DOT}|{_PLAIN_DOT})"
_AT_SIGN = re.compile(rf"@|{_BRACKET_AT}|\s+(?:at|arroba)\s+", re.IGNORECASE)
_HOST = re.compile(rf"{_LABEL}(?:{_ANY_DOT}{_LABEL})*?{_ANY_DOT}(?:{_TLDS})(?![\w-])", re.IGNORECASE)
# Where the sign leaves no doubt, any domain whose last label has two letters or more.
_ANY_HOST = re.compile(rf"{_LABEL}(?:{_ANY_DOT}{_LABEL})*{_ANY_DOT}[A-Za-z]{{2,}}(?![\w-])", re.IGNORECASE)
_ENDS_HOST = re.compile(rf"(?:{_TLDS}|[a-z]{{2}})", re.IGNORECASE)
_NAME_CHARACTERS = frozenset(ascii_letters + digits + "._%+-")
# "bob at example dot ru": any short ending, unless it is a word of prose and the disguise is not in capitals.
_SPOKEN_HOST = re.compile(rf"{_LABEL}(?:\s+dot\s+{_LABEL})*?\s+(dot)\s+([A-Za-z]{{2,3}})(?![\w-])", re.IGNORECASE)
# Short words of prose.
_PROSE_ENDS = frozenset(
    """a ago all am an and any are as at au be big but by can day de der des did die do du each el en end es et far few for
    get go had has he her him his how if il in is it its la le les lo los man may me men my new no nor not now of off old
    on one or our out own pas per que red run saw say see set she sie so son sur ten the to too top try two um un una und une
    up us use was way we who why yes yet you""".split()
)
_HOST_DOT = re.compile(_ANY_DOT, re.IGNORECASE)
_LABEL_ONLY = re.compile(_LABEL)
_DOT_PART = re.compile(rf"{_BRACKET_DOT}|{_PLAIN_DOT}", re.IGNORECASE)
_MAY_BE_ADDRESS = re.compile(
    rf"@\s*{_LABEL}(?:\.{_LABEL})*(?:{_DOT_PART.pattern})|{_BRACKET_AT}|{_BRACKET_DOT}|{_PLAIN_DOT}(?:{_TLDS})\b|\s+dot\s+[A-Za-z]{{2,3}}\b",
    re.IGNORECASE,
)
_TLD_LABEL = re.compile(rf"(?:{_TLDS})", re.IGNORECASE)
# Cheap tests that let texts pass by which cannot hold a match of the patterns above: in a run that
# is rewritten, each word stands apart from other letters and digits.
_CUE = re.compile(rf"\b(?:{_any([*_VALUE, *_TIMES, *_DOT_WORDS, *_PLUS_WORDS])})\b", re.IGNORECASE)
_CUE_DOT = re.compile(_any(_DOT_WORDS), re.IGNORECASE)
_BRACKETS = re.compile(r"[\[({<]")


def _spelled_run(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """Edits that turn one run of digit words into digits, dots and a plus."""
    times, done = 1, start
    for m in _DIGIT_TOKEN.finditer(text, start, end):
        word = m[0].lower()
        if word in _TIMES:
            times = _TIMES[word]
            continue
        new = "+" if word in _PLUS_WORDS else "." if word in _DOT_WORDS else _VALUE.get(word, word)
        yield done, m.end(), new * (times if word in _VALUE else 1)
        times, done = 1, m.end()


def _host_end(text: str, sign: re.Match) -> int:
    """Where the host after an at sign or its disguise ends; 0 if there is none."""
    sure = sign[0] == "@" or _has_bracket(sign[0])
    host = _ANY_HOST.match(text, sign.end())
    if host:
        # A dot word after a whole host is prose ("host dot com. Point taken"), unless a known end follows.
        low = host.start()
        for n, dot in enumerate(_HOST_DOT.finditer(text, host.start(), host.end())):
            after = _LABEL_ONLY.match(text, dot.end())
            spoken = dot[0] != "." and not _has_bracket(dot[0])
            if n and spoken and _ENDS_HOST.fullmatch(text, low, dot.start()) and not _TLD_LABEL.fullmatch(after[0]):
                host = _ANY_HOST.fullmatch(text, sign.end(), dot.start())
                break
            low = dot.end()
    if host and (sure or _has_bracket(host[0])):
        return host.end()
    host = None if sure else _HOST.match(text, sign.end())
    if not host and not sure:
        host = _SPOKEN_HOST.match(text, sign.end())
        capitals = sign[0].isupper() and host and host[1].isupper()
        if host and not capitals and host[2].lower() in _PROSE_ENDS:
            host = None
    return host.end() if host else 0


def _dot_before(text: str, end: int, low: int) -> int:
    """Where a disguised dot that ends at ``end`` begins; -1 if there is none."""

    def back(at: int) -> int:
        while at > low and text[at - 1].isspace():
            at -= 1
        return at

    at = back(end)
    bracket = at > low and text[at - 1] in "])}>"
    if not bracket and at == end:
        return -1
    at = back(at - 1) if bracket else at
    before = text[max(low, at - _LONGEST_DOT) : at].lower()
    word = next((w for w in (*_DOT_WORDS, ".") if before.endswith(w) and (bracket or w != ".")), None)
    if word is None:
        return -1
    start = back(at - len(word))
    if not bracket:
        return start if start < at - len(word) else -1
    return back(start - 1) if start > low and text[start - 1] in "[({<" else -1


def _name_start(text: str, end: int, low: int) -> int:
    """Where the name that ends at ``end`` begins, disguised dots inside it included; -1 if there is none."""
    start, at = -1, end
    while at >= 0:
        part = at
        while part > low and text[part - 1] in _NAME_CHARACTERS:
            part -= 1
        if part == at:
            break
        start, at = part, _dot_before(text, part, low)
    return start


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    done = 0
    for sign in _AT_SIGN.finditer(text):
        if sign.start() < done:
            continue
        end = _host_end(text, sign)
        if not end:
            continue
        name = _name_start(text, sign.start(), done)
        dots = list(_DOT_PART.finditer(text, sign.end(), end))
        if name < 0 or (sign[0][:1].isspace() and not _has_bracket(sign[0]) and not dots):
            continue  # "look at host.org" is plain prose
        for dot in _DOT_PART.finditer(text, name, sign.start()):
            yield *dot.span(), "."
        if sign[0] != "@":
            yield *sign.span(), "@"
        for dot in dots:
            yield *dot.span(), "."
        done = end


def _has_bracket(text: str) -> bool:
    return any(c in "[({<" for c in text)


def _disguises(text: str) -> Tape | None:
    edits = []
    for m in _DIGIT_RUN.finditer(text) if _CUE.search(text) else ():
        if any(c.isalpha() for c in m[0]):
            edits += _spelled_run(text, *m.span())
    if _DIGIT.search(text):
        for m in _LETTERED.finditer(text):
            digits = sum(map(str.isdigit, m[0]))
            letters = sum(m[0].count(c) for c in "OolI")
            if 0 < letters <= digits and digits >= 4:
                new = m[0].translate(_DIGIT_LETTERS)
                edits += [(m.start() + k, m.start() + k + 1, c) for k, c in enumerate(new) if m[0][k] != c]
    if _CUE_DOT.search(text) or _BRACKETS.search(text):
        if _MAY_BE_ADDRESS.search(text):
            edits += _addresses(text)
    apart, done = [], 0
    for edit in sorted(edits):
        if edit[0] >= done:
            apart.append(edit)
            done = edit[1]
    return Tape(text, apart) if apart else None


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only show after rewriting, in source offsets."""
    first = _characters(text)
    read = first.text if first else text
    second = _disguises(read)
    if not first and not second:
        return []
    taken: dict[str, list[tuple[int, int]]] = {}
    for kind, start, end in base:
        taken.setdefault(kind, []).append((start, end))
    found = []
    for tapes in [(first,), (second, first)]:
        if not tapes[0]:
            continue
        for kind, start, end in plain_spans(tapes[0].text):
            changed = False
            for tape in tapes:
                if tape:
                    start, end, touched = tape.back(start, end)
                    changed |= touched
            own = taken.setdefault(kind, [])
            if changed and not any(s < end and start < e for s, e in own):
                own.append((start, end))
                found.append((kind, start, end))
    return found


# ---- operator ---------------------------------------------------------------------------


def _listed(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, base counts, ``base_spans``, ``spans`` (with the added ones)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                base = plain_spans(text)
                counts = [sum(kind == s[0] for s in base) for kind in KINDS]
                plain = _listed(base)
                more = hidden_spans(text, base)
                digest = hashlib.sha256(plain.encode()).hexdigest()
                rows.append((*counts, digest, _listed(base + more) if more else plain, len(more)))
            names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_hidden"]
            found = pd.DataFrame(rows, columns=names)
            found.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield found

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"{counts}, base_sha256 string, spans string, n_hidden long"
    return map_rows(docs.select("doc_id", "text"), "doc_id", run, schema)
