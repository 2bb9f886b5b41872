r"""Operator 12: line dedup with two Bloom filters.

A line's key is the line without ``[\x20\x09-\x0D]`` at both ends and with A-Z lower-cased. Keys of at least ``min_chars`` code
points that at least ``min_docs`` documents hold lose their lines everywhere but in the document of the largest id.

1. Every task fills two filters with the 64-bit hashes of its documents' keys (each key once per document): a hash not yet in
   the first goes there, a hash already there goes to the second as well. Filters of tasks are merged block by block:
   ``(B1, B2) + (C1, C2) = (B1 | C1, B2 | C2 | B1 & C1)``, which loses no hash seen twice.
2. Only keys whose hash is in the merged second filter are suspects. Their SHA-256 digests are shuffled (partial counts
   first, so a line that a third of all documents share is one row per task) and confirmed exactly: number of documents and largest id.
3. Lines of confirmed keys go. The confirmed keys are broadcast if counted and at most ``broadcast_keys``; beyond that the
   suspects are joined with them and each document with the digests of the lines it loses.

The filters have one bit for every 8 bytes of text, at most ``max_bits``: a fuller filter gives more suspects, never another result.

Defined cases: a null or empty text is one empty line; every row counts as a document, also rows that repeat an id; a
null id is smaller than any other; if all lines go, the text is empty; lines that stay keep their bytes (``\r`` too); a
text or line of any length is read whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import batch_slices, bytes_of, narrow, stored

MIN_CHARS, MIN_DOCS = 40, 5
MAX_BITS = 1 << 29         # 64 MB a filter
BROADCAST_KEYS = 200_000
PROBES = 3
BLOCK = 1 << 12            # bytes of a filter that are merged as one row
BLANK = b" \t\n\x0b\x0c\r"
INSIDE = bytes(range(0x80, 0xC0))
OUT = "doc_id long, n_lines long, n_dropped long, text string"


def line_keys(lines: list[bytes], min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The key of each line, None where it is too short."""
    out = []
    for line in lines:
        key = line.strip(BLANK)
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.translate(None, INSIDE)) >= min_chars)
        out.append(key.lower() if long else None)      # bytes: A-Z alone
    return out


class Bloom:
    """A filter of a power of two bits over 64-bit hashes."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def places(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        turns = np.arange(PROBES, dtype=np.uint64)[:, None]
        return (hashes + turns * step) & np.uint64(self.bits - 1)

    def add(self, hashes: np.ndarray) -> None:
        at = np.unique(self.places(hashes))
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        return ((self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def add_once_twice(once: Bloom, twice: Bloom, hashes: np.ndarray) -> None:
    """Add hashes (one occurrence each per document) to the pair of filters."""
    values, counts = np.unique(hashes, return_counts=True)
    twice.add(values[(counts > 1) | once.has(values)])
    once.add(values)


def _hashes(texts: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct keys of each text: hash, number of the text, key."""
    found, which, keys = [], [], []
    for i, raw in enumerate(texts):
        for key in set(line_keys(raw.split(b"\n"), min_chars)) - {None}:
            found.append(xxhash.xxh3_64_intdigest(key))
            which.append(i)
            keys.append(key)
    return np.array(found, np.uint64), np.array(which, np.int64), keys


def twice_seen(rows: DataFrame, bits: int, min_chars: int = MIN_CHARS) -> Bloom:
    """The filter of the hashes that at least two documents hold (all of them, and a few more); ``bits / 8`` bytes on the driver."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(bits), Bloom(bits)
        for whole in batches:
            for batch in batch_slices(whole, 1):
                add_once_twice(once, twice, _hashes(bytes_of(batch.column(1)), min_chars)[0])
        a, b = once.data.reshape(-1, size), twice.data.reshape(-1, size)
        used = np.flatnonzero(a.any(axis=1))
        for i in range(0, len(used), 256):
            part = used[i:i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([a[k].tobytes() for k in part], pa.binary()),
                                              pa.array([b[k].tobytes() if b[k].any() else None for k in part], pa.binary())], names=["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a, b = None, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            done = []
            for block, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if block != now:
                    if now is not None and b.any():
                        done.append((now, b.tobytes()))
                    now, a, b = block, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
                x = np.frombuffer(x.as_buffer(), np.uint8)
                b |= a & x
                a |= x
                if y.is_valid:
                    b |= np.frombuffer(y.as_buffer(), np.uint8)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([v for _, v in done], pa.binary())], names=["block", "twice"])
        if now is not None and b.any():
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b.tobytes()], pa.binary())], names=["block", "twice"])

    size = min(BLOCK, bits // 8)
    merged = (rows.mapInArrow(fill, "block long, once binary, twice binary").repartition("block").sortWithinPartitions("block")
              .mapInArrow(merge, "block long, twice binary"))
    out = Bloom(bits)
    blocks = out.data.reshape(-1, size)
    for batch in merged.toArrow().to_batches():
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            blocks[block] = np.frombuffer(data.as_buffer(), np.uint8)
    return out


def filter_bits(rows: DataFrame, max_bits: int = MAX_BITS) -> int:
    """One bit for every 8 bytes of text (a key has at least 40), as a power of two within bounds."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max_bits, max(1 << 12, 1 << (size // 8).bit_length()))


def suspects(rows: DataFrame, filter_: Bloom, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key, h, digest of every key whose hash the filter has, once per document."""
    spread = rows.sparkSession.sparkContext.broadcast(filter_.data)
    bits = filter_.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bloom(bits, spread.value)
        for whole in batches:
            for batch in batch_slices(whole, 1):
                h, which, keys = _hashes(bytes_of(batch.column(1)), min_chars)
                hit = np.flatnonzero(known.has(h)) if len(h) else np.zeros(0, np.int64)
                take = pa.array(which[hit])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(2).take(take), pa.array(h[hit].view(np.int64)),
                     pa.array([hashlib.sha256(keys[i]).digest() for i in hit], pa.binary())], names=["doc_id", "text_key", "h", "digest"])

    return (rows.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
            .mapInArrow(run, "doc_id long, text_key long, h long, digest binary"))


def _kept(raw: bytes, doc_id: int | None, loses, min_chars: int) -> tuple[int, int, bytes]:
    lines = raw.split(b"\n")
    stay = [line for line, key in zip(lines, line_keys(lines, min_chars)) if key is None or not loses(key, doc_id)]
    return len(lines), len(lines) - len(stay), raw if len(stay) == len(lines) else b"\n".join(stay)


def _written(ids: pa.Array, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


def _drop_broadcast(rows: DataFrame, confirmed: DataFrame, min_chars: int) -> DataFrame:
    """Confirmed keys (a bounded number) in every task."""
    table = confirmed.select("h", "digest", "keep_id").toArrow()
    spread = rows.sparkSession.sparkContext.broadcast(
        (set(table["h"].to_pylist()), dict(zip(table["digest"].to_pylist(), table["keep_id"].to_pylist()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, keep = spread.value

        def loses(key: bytes, doc_id: int | None) -> bool:
            h = xxhash.xxh3_64_intdigest(key)
            if (h - (1 << 64) if h >> 63 else h) not in short:
                return False
            digest = hashlib.sha256(key).digest()
            return digest in keep and keep[digest] != doc_id

        for whole in batches:
            for batch in batch_slices(whole, 1):
                ids = batch.column(0)
                yield _written(ids, [_kept(t, i, loses, min_chars) for i, t in zip(ids.to_pylist(), bytes_of(batch.column(1)))])

    return rows.select("doc_id", "text").mapInArrow(run, OUT)


def _drop_shuffled(rows: DataFrame, found: DataFrame, confirmed: DataFrame, min_chars: int) -> DataFrame:
    """Any number of confirmed keys: each document meets the digests of the lines that it loses (no more than it has lines)."""
    lost = (found.join(confirmed.select("digest", "keep_id"), "digest").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set("digest").alias("lost")))
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    met = keyed.join(lost, keyed["doc_id"].eqNullSafe(lost["__id"]) & (keyed["text_key"] == lost["__key"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batch_slices(whole, 1):
                out = []
                for raw, lost in zip(bytes_of(batch.column(1)), batch.column(2).to_pylist()):
                    gone = set(lost or ())
                    out.append(_kept(raw, None, lambda key, _: bool(gone) and hashlib.sha256(key).digest() in gone, min_chars))
                yield _written(batch.column(0), out)

    return met.select("doc_id", "text", "lost").mapInArrow(run, OUT)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               max_bits: int = MAX_BITS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, text (the lines that stay)."""
    if min_docs < 2:
        raise ValueError("a line that one document holds is no repeat: min_docs must be 2 or more")
    rows = narrow(docs, id_col, text_col)
    found = stored(suspects(rows, twice_seen(rows, filter_bits(rows, max_bits), min_chars), min_chars), "line-suspects")
    confirmed = stored(found.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.min("h").alias("h"))
                       .where(F.col("n") >= min_docs), "line-repeats")
    if confirmed.count() <= broadcast_keys:
        return _drop_broadcast(rows, confirmed, min_chars)
    return _drop_shuffled(rows, found, confirmed, min_chars)
