"""Vector best-fit packing of tokenized documents into fixed-length sequences.

Each document becomes its token ids and an end id; one longer than a sequence is cut into
pieces of full length, the rest being the first piece. A piece asks for three things of a
bin: tokens, one place in its document count, and attention cost (its length squared).
Pieces go in falling order of length to the open bin that can take them under every capacity
and that the rule likes best: ``norm`` takes the smallest weighted norm of what the bin has
left afterwards, ``dot`` the largest weighted product of what the piece asks and what the
bin has left. If none can take it, a bin is opened.

Scale: tokenizing is one scan that returns pieces as (place, length, checksum) and moves no text.
Pieces are dealt round robin into shards of about ``SHARD`` pieces, whose number grows with
the data, and each shard is packed on its own; so a task holds a bounded number of small rows
whatever repeats, and what the shards' last bins waste is a fixed share. Spark orders rows
before it deals them, and a shard orders its pieces, so a task that runs again gives
the same bins.

Tokens are made by tiktoken from the ranks of the same vocabulary, which gives the ids of
the ``tokenizers`` file at over four times the speed (tests compare them). With ``added``, a string of a
special token in a text becomes its id, as the file does at its defaults; without it, it is
ordinary text. The queries set ``added``.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are
packed like others; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from redressa.llm.common import map_rows
from redressa.session import materialize

TOKENS = 1024
END = 2
SHARD = 16_384
PIECE = "piece int, start long, length long, ids_crc32 long"
ADDED = (("<|endoftext|>", 50_256),)
WEIGHTS = (1.0, 0.001, 0.001)
# Blanks in a row that the pattern would need too deep a stack for.
LONG_BLANKS = 20_000
_BLANKS = regex.compile(rf"\p{{White_Space}}{{{LONG_BLANKS},}}")


@lru_cache(maxsize=2)
def encoder(path: str, added: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(added)
    )


def token_ids(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text, special tokens as themselves.

    The pattern makes one part of a run of blanks, less the last one if a character follows; very long runs
    are cut out the same way here and encoded by themselves.
    """
    ids, done = [], 0
    for run in _BLANKS.finditer(text) if len(text) >= LONG_BLANKS else ():
        end = run.end()
        if end < len(text) and not text.startswith(tuple(encoding.special_tokens_set), end):
            end -= 1
        ids += encoding.encode(text[done : run.start()], allowed_special="all")
        ids += encoding._encode_single_piece(text[run.start() : end].encode())
        done = end
    return ids + encoding.encode(text[done:], allowed_special="all")


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be short."""
    first = n % most or most
    return [(0, min(first, n)), *((at, most) for at in range(first, n, most))]


def pieces(
    docs: DataFrame, path: str, tokens: int = TOKENS, end: int = END, added: tuple[tuple[str, int], ...] = ()
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = encoder(path, added)
        for batch in batches:
            rows = []
            for at, text in enumerate(batch["text"]):
                ids = np.array([*token_ids(encoding, text or ""), end], dtype="<u4")
                for number, (start, length) in enumerate(cut(len(ids), tokens)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    rows.append((at, number, start, length, crc))
            found = pd.DataFrame(rows, columns=["at", "piece", "start", "length", "ids_crc32"])
            found.insert(0, "doc_id", batch["doc_id"].to_numpy()[found.pop("at").to_numpy(dtype=int)])
            yield found

    return map_rows(docs.select("doc_id", "text"), "doc_id", run, PIECE)


def best_fit(
    lengths: np.ndarray,
    tokens: int = TOKENS,
    documents: int | None = None,
    attention: int | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = WEIGHTS,
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; lengths are taken in the order given."""
    caps = np.array([tokens, documents or tokens, attention or tokens * tokens], dtype=np.int64)
    if len(lengths) and (lengths.max() > caps[0] or lengths.max() ** 2 > caps[2]):
        raise ValueError("a piece is over a capacity by itself")
    scale = np.array(weights) / caps.astype(float) ** 2
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    left = np.empty((3, 1024), dtype=np.int64)  # of the open bins
    names = np.empty(1024, dtype=np.int64)
    n_open = n_bins = 0
    least = int(lengths.min()) if len(lengths) else 0
    for at, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length])
        place = -1
        if n_open and length < tokens:
            now = left[:, :n_open]
            fits = np.flatnonzero((now[0] >= length) & (now[1] >= 1) & (now[2] >= need[2]))
            if len(fits):
                some = now[:, fits]
                if rule == "norm":
                    value = scale @ ((some - need[:, None]).astype(float) ** 2)
                else:
                    value = -((scale * need) @ some)
                place = int(fits[value.argmin()])
        if place < 0:
            if n_open == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], axis=1)
                names = np.concatenate([names, np.empty_like(names)])
            place = n_open
            left[:, place], names[place] = caps, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[at], offsets[at] = names[place], tokens - left[0, place]
        left[:, place] -= need
        if left[0, place] < least or left[1, place] < 1 or left[2, place] < least * least:
            n_open -= 1  # closed: the last open bin takes its column
            left[:, place], names[place] = left[:, n_open], names[n_open]
    return bins, offsets


def pack(
    found: DataFrame,
    tokens: int = TOKENS,
    documents: int | None = None,
    attention: int | None = None,
    rule: str = "norm",
    shard: int = SHARD,
) -> DataFrame:
    """``found`` (from ``pieces``) with ``sequence_id`` and ``offset``."""
    found = materialize(found, "pieces")
    shards = max(1, -(-found.count() // shard))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        rows = rows.sort_values(
            ["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable"
        )
        bins, offsets = best_fit(
            rows["length"].to_numpy(), tokens, documents, attention, rule
        )
        base = TaskContext.get().partitionId() << 32
        yield rows.assign(sequence_id=base + bins, offset=offsets)

    return map_rows(found.repartition(shards), "doc_id", run, f"{PIECE}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, path: str | None = None, added: tuple[tuple[str, int], ...] = (), **options
) -> DataFrame:
    """Pieces of all ``docs`` with their places, by the tokenizer ranks at ``path``."""
    path = path or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pack(pieces(docs, path, options.get("tokens", TOKENS), added=added), **options)
