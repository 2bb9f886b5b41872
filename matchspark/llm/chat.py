r"""Operator 4: chat formatting by columnar byte assembly.

Template, per turn: ``<s>[INST] `` role ``\n`` text `` [/INST]</s>\n``. Inside roles and texts
a backslash is put before every ``<``, ``[`` and backslash (in roles also before a line break), so a control string in a text
never reads as one, and removing one backslash each gives the text back.

The turns of a conversation are brought together (hash partitioned and sorted by conversation and
turn); each Arrow batch is one piece of columnar work: the lengths of all segments (header, role, break,
text, footer) give offsets by a cumulative sum, each output byte gets its place in one preallocated
buffer by numpy scatters, and that buffer becomes the Arrow column without another copy. A
conversation that spans batches gives several rows (``piece`` 0, 1, ...), so no task holds a whole conversation.

Defined cases: a null text or role counts as empty; a null conv_id is a conversation of its own; turns that
tie (or are null: first) are ordered by role and text; repeated rows are repeated turns; an empty
table gives an empty result; a text of any length is one segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import batch_slices, bytes_of

HEAD, BREAK, FOOT = b"<s>[INST] ", b"\n", b" [/INST]</s>\n"
ESCAPE = ord("\\")
ESCAPED = np.zeros(256, bool)
ESCAPED[[ord("<"), ord("["), ESCAPE]] = True
ESCAPED_ROLE = ESCAPED.copy()
ESCAPED_ROLE[ord("\n")] = True
LOSS_ROLE = "assistant"
MOST_BYTES = 2 ** 31 - 1  # offsets of an Arrow binary column are 32 bits wide
SCHEMA = "conv_id long, piece int, n_turns long, formatted binary, loss array<struct<start:int,stop:int>>"


def _escaped_places(data: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, its place behind the escapes up to it; and the total by byte (exclusive)."""
    extra = np.cumsum(special[data], dtype=np.int64)
    return np.arange(len(data), dtype=np.int64) + extra, extra


def assemble(roles: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns, the offset of each turn (n + 1), and start and stop of each text."""
    n = len(texts)
    sides = []
    for parts, special in ((roles, ESCAPED_ROLE), (texts, ESCAPED)):
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n))
        place, extra = _escaped_places(data, special)
        until = np.concatenate([[0], extra])[ends]            # escapes in all segments up to and with this one
        sides.append((data, ends, place, special, np.diff(until + ends, prepend=0)))
    role_len, text_len = sides[0][4], sides[1][4]
    lengths = len(HEAD) + role_len + len(BREAK) + text_len + len(FOOT)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    begin = offsets[:-1]
    out = np.empty(offsets[-1], np.uint8)
    role_at = begin + len(HEAD)
    text_at = role_at + role_len + len(BREAK)
    for constant, at in ((HEAD, begin), (BREAK, role_at + role_len), (FOOT, text_at + text_len)):
        for k, b in enumerate(constant):
            out[at + k] = b
    for (data, ends, place, special, size), at in zip(sides, (role_at, text_at)):
        if not len(data):
            continue
        first = np.cumsum(size) - size                        # where the segment starts among the escaped bytes
        move = np.repeat(at - first, np.diff(ends, prepend=0))
        out[place + move] = data
        hit = special[data]
        out[(place + move)[hit] - 1] = ESCAPE
    return out, offsets, text_at, text_at + text_len


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """conv_id, piece, n_turns, formatted (bytes), loss (byte spans of the texts whose role is
    ``assistant``); pieces of a conversation follow each other in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, piece = object(), 0
        for batch in (part for whole in batches for part in batch_slices(whole, 2)):
            ids = batch.column(0).to_pylist()
            if not ids:
                continue
            roles, texts = bytes_of(batch.column(1)), bytes_of(batch.column(2))
            out, offsets, start, stop = assemble(roles, texts)
            if offsets[-1] > MOST_BYTES:
                raise ValueError(f"a formatted turn of {offsets[-1]} bytes does not fit an Arrow buffer of {MOST_BYTES}")
            cuts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]] + [len(ids)]
            pieces = []
            for i in cuts[:-1]:
                piece = piece + 1 if ids[i] == last else 0
                last = ids[i]
                pieces.append(piece)
            last = ids[-1]
            at = offsets[cuts]
            assistant = np.fromiter((r == LOSS_ROLE.encode() for r in roles), bool, len(roles))
            group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            spans = pa.StructArray.from_arrays(
                [pa.array((x - at[group])[assistant].astype(np.int32)) for x in (start, stop)], names=["start", "stop"])
            counts = np.bincount(group[assistant], minlength=len(cuts) - 1)
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in cuts[:-1]], pa.int64()), pa.array(pieces, pa.int32()),
                pa.array(np.diff(cuts).astype(np.int64)),
                pa.Array.from_buffers(pa.binary(), len(cuts) - 1,
                                      [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)]),
                pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), spans),
            ], names=["conv_id", "piece", "n_turns", "formatted", "loss"])

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(role_col, F.lit("")).alias("role"),
                        F.coalesce(text_col, F.lit("")).alias("text"), F.col(turn_col).alias("__turn"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "__turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(run, SCHEMA))


def unescape(data: bytes) -> bytes:
    """Remove the backslash in front of each escaped byte."""
    if b"\\" not in data:
        return data
    raw = np.frombuffer(data, np.uint8)
    slash = raw == ESCAPE
    # in a run of backslashes every second one is a text's own; the first of each pair is dropped
    starts = np.flatnonzero(slash & ~np.concatenate([[False], slash[:-1]]))
    index = np.arange(len(raw))
    run_start = np.zeros(len(raw), np.int64)
    run_start[starts] = starts
    run_start = np.maximum.accumulate(run_start)
    return raw[~(slash & ((index - run_start) % 2 == 0))].tobytes()


def read_turns(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of each turn, from the formatted bytes alone."""
    at = 0
    while at < len(formatted):
        if formatted[at:at + len(HEAD)] != HEAD:
            raise ValueError(f"no turn at byte {at}")
        at += len(HEAD)
        end = formatted.index(BREAK, at)
        while _slashes(formatted, end) % 2:
            end = formatted.index(BREAK, end + 1)
        role, at = formatted[at:end], end + 1
        end = formatted.index(FOOT, at)
        while _slashes(formatted, end + 1) % 2:
            end = formatted.index(FOOT, end + 1)
        yield unescape(role), unescape(formatted[at:end])
        at = end + len(FOOT)


def _slashes(data: bytes, at: int) -> int:
    """Backslashes directly in front of ``at``."""
    n = 0
    while at - n > 0 and data[at - n - 1] == ESCAPE:
        n += 1
    return n


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the output of ``format_conversations`` (whose row order it
    keeps): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def code_points(data: bytes) -> int:
        raw = np.frombuffer(data, np.uint8)
        return int(np.count_nonzero((raw & 0xC0) != 0x80))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # conv_id, turns, hash of the turns, characters and hash under the mask, characters

        def done(o):
            return [o[0], o[1], o[2].hexdigest(), o[3], o[4].hexdigest(), o[5]]

        for batch in batches:
            rows = []
            for conv, piece, n, data, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if piece == 0 and open_ is not None:
                    rows.append(done(open_))
                if piece == 0:
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(data):
                    open_[1] += 1
                    open_[2].update(role + b"\n" + text + b"\n")
                for s in spans:
                    text = unescape(data[s["start"]:s["stop"]])
                    open_[3] += code_points(text)
                    open_[4].update(text)
                open_[5] += code_points(data)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, done(open_)))], schema=kinds)

    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                       ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")
