"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Writing. A dictionary is made from a bounded sample of payloads. Pages with equal payloads
of ``REVISIT_BYTES`` bytes or more are one response, of the largest page_id, and revisits of it;
who refers to whom is settled on digests alone, so one payload that a third of the pages
share is a third of some narrow rows, spread by a salt. Each task then writes one archive. The bytes go
through Spark's text sink with a separator that is itself an empty skippable frame
(its eight bytes are plain ASCII), so archives are valid, live on any file system
that Spark writes to, and are committed once if a task runs again.

Reading. An archive is a leading dictionary frame (magic 0x184D2A5D; its content may be a
Zstandard frame itself), then frames; other skippable frames are passed over. Frames are decoded
piece by piece, each must hold one whole record, and version line, header fields, content
length, block and payload digests are checked. A record that fails is returned with ``error``; a
frame that cannot be decoded ends its archive with one such row.

An archive is what one input split makes, and a read holds the archives of one split.

Defined results: a null html is an empty payload. A null url is an empty target. Rows with a null
page_id are responses without a page number, read back as null. Repeated rows with one page_id and payload
have one response for each row with the largest page_id. An empty table gives no record.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redressa.session import fresh_path, materialize

DICTIONARY_MAGIC = 0x184D2A5D.to_bytes(4, "little")
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528.to_bytes(4, "little")
# An empty skippable frame (magic 0x184D2A50, length 0): ASCII, and so a text separator.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
REVISIT_BYTES = 1000
SAMPLE_PAGES = 256
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
SALTS = 32
PIECE = 1 << 16
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

RECORD = (
    "archive string, number long, record_id string, record_type string, target string, page_id long,"
    " refers_to long, payload_bytes long, payload_digest string, payload binary, error string"
)


# ---- records ----------------------------------------------------------------------------


def make_record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC record; a revisit (``refers_to`` given) has no block."""
    name = "" if page_id is None else int(page_id)
    digest = hashlib.sha1(payload).hexdigest()
    block = payload if refers_to is None else b""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{int(refers_to)}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BadRecord(ValueError):
    pass


def _page(value: str | None) -> int | None:
    if not value:
        return None
    inner = value.removeprefix("<urn:page:").removesuffix(">")
    if f"<urn:page:{inner}>" != value:
        raise BadRecord(f"record id {value!r}")
    return int(inner) if inner else None


def parse_record(data: bytes) -> dict:
    """Fields and payload of one whole record; BadRecord says what is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise BadRecord("no WARC version line and header end")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadRecord(f"header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    missing = [n for n in REQUIRED if n not in fields]
    if missing:
        raise BadRecord(f"no {', '.join(missing)}")
    if not fields["content-length"].isdigit():
        raise BadRecord(f"content length {fields['content-length']!r}")
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise BadRecord(f"content length {length} does not fit the frame")
    _check_digest(fields.get("warc-block-digest"), block)
    kind = fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        digest = _check_digest(fields.get("warc-payload-digest"), block) or digest
    elif kind == "revisit":
        if length or digest is None or not fields.get("warc-refers-to"):
            raise BadRecord("revisit with a block, or without a digest or a reference")
    return {
        "record_id": fields["warc-record-id"],
        "record_type": kind,
        "target": fields.get("warc-target-uri"),
        "page_id": _page(fields["warc-record-id"]),
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload_bytes": length if kind == "response" else None,
        "payload_digest": digest,
        "payload": block if kind == "response" else None,
    }


def _check_digest(named: str | None, data: bytes) -> str | None:
    if named is None:
        return None
    method, _, value = named.partition(":")
    if method != "sha1" or hashlib.sha1(data).hexdigest() != value:
        raise BadRecord(f"digest {named!r}")
    return value


# ---- frames -----------------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    """A skippable frame with the dictionary, itself compressed."""
    inner = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return DICTIONARY_MAGIC + len(inner).to_bytes(4, "little") + inner


def read_dictionary(data: bytes) -> tuple[bytes, int]:
    """Dictionary of the leading frame (empty without one), and where frames begin."""
    if data[:4] != DICTIONARY_MAGIC:
        return b"", 0
    size = int.from_bytes(data[4:8], "little")
    inner = bytes(data[8 : 8 + size])
    if len(data) < 8 or len(inner) != size:
        raise BadRecord("dictionary frame is cut short")
    if inner[:4] == FRAME_MAGIC:
        inner = zstandard.ZstdDecompressor().decompressobj().decompress(inner)
    return inner, 8 + size


def read_frames(data: bytes) -> Iterator[bytes]:
    """Content of each frame after the dictionary; skippable frames are passed over."""
    view = memoryview(data)
    dictionary, at = read_dictionary(data)
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    decoder = zstandard.ZstdDecompressor(dict_data=trained)
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if len(view) - at < 8 or at + 8 + size > len(view):
                raise BadRecord("skippable frame is cut short")
            at += 8 + size
            continue
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise BadRecord("frame is cut short")
            piece = view[at : at + PIECE]
            try:
                parts.append(frame.decompress(piece))
            except zstandard.ZstdError as wrong:
                raise BadRecord(f"frame at byte {at}: {wrong}") from wrong
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def read_archive(data: bytes) -> Iterator[dict]:
    """A row for each record, or for what is wrong with it."""
    try:
        for frame in read_frames(data):
            try:
                yield parse_record(frame) | {"error": None}
            except (BadRecord, ValueError) as wrong:
                yield {"error": str(wrong)}
    except BadRecord as wrong:
        yield {"error": str(wrong)}


# ---- Spark ------------------------------------------------------------------------------


def train_dictionary(pages: DataFrame) -> bytes:
    """From at most ``SAMPLE_PAGES`` payloads, the first ``SAMPLE_BYTES`` bytes of each.

    Pages are picked by smallest hash of their id and length. Where they are too few to train on,
    their bytes are the dictionary as they are.
    """
    usable = pages.filter("html IS NOT NULL AND html <> ''")
    # A hash threshold leaves few more rows than are wanted, and only their prefixes are sorted.
    part = min(1.0, 4 * SAMPLE_PAGES / max(usable.count(), 1))
    hashed = F.xxhash64("page_id", F.octet_length("html")).alias("hash")
    picked = (
        usable.select("page_id", hashed, F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES).alias("b"))
        .filter(F.pmod("hash", F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
        .orderBy("hash", "page_id", F.xxhash64("b"))
        .limit(SAMPLE_PAGES)
        .select("b")
        .collect()
    )
    samples = [bytes(r.b) for r in picked]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def with_references(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html``, and ``refers_to`` of the pages that revisit another."""
    html = F.coalesce(F.col("html"), F.lit(""))
    narrow = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    narrow = narrow.filter((F.col("bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).drop("bytes")
    largest = narrow.groupBy("digest").agg(
        F.max("page_id").alias("largest"), F.min("page_id").alias("least")
    )
    # Only payloads of several pages matter; each is copied to all salts.
    shared = materialize(
        largest.filter("largest <> least").select(
            "digest", "largest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        ),
        "payloads",
    )
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    references = (
        narrow.withColumn("salt", salt)
        .join(shared, ["digest", "salt"])
        .filter("page_id <> largest")
        .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("largest").alias("refers_to"))
        .distinct()
    )
    own = pages.select("page_id", "url", "html")
    same = (own["page_id"] == references["_page"]) & (
        F.sha1(F.coalesce(own["html"], F.lit("")).cast("binary")) == references["_digest"]
    )
    return own.join(references, same, "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, path: str, level: int = 6) -> str:
    """Write ``pages`` as archives into the new folder ``path``."""
    dictionary = train_dictionary(pages)

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True).compress
        started = False
        for batch in batches:
            found = [] if started or not dictionary or batch.empty else [dictionary_frame(dictionary)]
            started |= bool(len(batch))
            for row in batch.itertuples(index=False):
                page = None if pd.isna(row.page_id) else row.page_id
                refers = None if pd.isna(row.refers_to) else row.refers_to
                payload = (row.html or "").encode()
                found.append(compress(make_record(page, row.url, payload, refers)))
            yield pd.DataFrame({"frame": found})

    ready = with_references(pages).withColumns(
        {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    )
    written = ready.mapInPandas(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    written.write.option("lineSep", SEPARATOR).text(path)
    return path


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in ``path``, checked; with its payload or not."""
    schema = RECORD if payloads else RECORD.replace(" payload binary,", "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(",")]
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for number, found in enumerate(read_archive(bytes(content))):
                    rows.append({"archive": archive, "number": number} | found)
                    size += len(found.get("payload") or b"") + 200
                    if size > (1 << 23):
                        yield _frame(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows, names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, schema)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    table = pd.DataFrame(rows, columns=names, dtype=object)
    for name in ("page_id", "refers_to", "payload_bytes"):
        table[name] = table[name].astype("Int64")
    return table


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages``, read them back: a row for each record, revisits with the full
    payload's size from the response they refer to."""
    path = write_archives(pages, fresh_path(spark, "warc"))
    records = materialize(read_archives(spark, path, payloads=False), "records")
    responses = records.filter("record_type = 'response' AND payload_digest IS NOT NULL")
    full = responses.select(
        F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")
    ).distinct()
    revisits = records.filter("record_type = 'revisit'")
    same = (revisits["refers_to"] == full["_page"]) & (revisits["payload_digest"] == full["_digest"])
    resolved = revisits.join(full, same, "left").select(
        *[F.col("_bytes").alias(c) if c == "payload_bytes" else revisits[c] for c in revisits.columns if c != "error"],
        F.when(F.col("_bytes").isNull(), F.lit("no response with this payload")).alias("error"),
    )
    others = records.filter(~F.col("record_type").eqNullSafe("revisit"))
    return others.unionByName(resolved)
