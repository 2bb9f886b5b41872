"""Operator 6: SimHash near-duplicates by meet-in-the-middle ball hashing.

**Fingerprints.** Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, shingles of ``size`` words
joined by spaces (repeats count; a shorter text is one shingle), XXH64 with seed 42 of each; a bit is set
if it is set in more than half of the hashes. No word: fingerprint zero.

**Links.** Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both. So each distinct fingerprint
emits all variants within r = radius / 2 bits, variants meet in a shuffle, and the fingerprints of one variant are
colliding pairs; they are verified by their bit distance.

*Compact variants.* The shuffle key is the first ``prefix`` bits of a variant. A fingerprint sends one
row per prefix its variants have (the prefix and the bits left to flip), which stands for all
variants with that prefix; the receiving task spells them out a block at a time, sorts them and finds those
met more than once. That is the shuffle on variants with 1 + p + p(p-1)/2 rows per fingerprint
instead of 2,081, and p grows with the number of fingerprints so that a block keeps its size.

*No pairs within a group.* All fingerprints of one variant are within ``radius`` of each other (r + r), so the
least one linked with each of the others connects them all; a task keeps a spanning forest of the
links it has found (union-find over its block), at most one row per fingerprint it received.

*Hot groups.* Copies of a text share one fingerprint, which is counted once; near copies have different ones,
and a variant has at most 2,081 distinct fingerprints around it whatever the size of the corpus.
Many different fingerprints may still share their leading bits: the rows of each key are counted first, and a key with
more than ``HOT_KEY`` rows is cut by its next ``STEP`` bits into keys of their own, again and again until none is hot
(a key of 64 bits is one variant). A block that is too large is spelled out in slices of its next bits.

**Components** by alternating large-star / small-star rounds on the links (each row is a link; stored between rounds), and
the smallest document id per component by an aggregate.

Defined cases: a text of any length is read as a whole, a slice of some MB of texts at a time; other columns are not
read; null and empty texts have fingerprint zero and link like any other; null ids count as the largest id
(a component of null ids only has a null component_id); repeated rows give repeated result rows; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import BROADCAST_IDS, batch_slices, bytes_of, narrow, stored, without_ids
from matchspark.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCK = 1 << 20     # variants spelled out at a time
PER_KEY = 1 << 11   # fingerprint rows wanted per shuffle key on average
HOT_KEY = 1 << 15   # a key with more rows is cut by its next bits
STEP = 8            # bits of one cut


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    import xxhash

    words = text.lower().split()  # bytes: lowers A-Z only, splits at ASCII blanks only
    if not words:
        return 0
    n = len(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n - size + 1].tolist(), ends[size - 1:].tolist())),
                         np.uint64, n - size + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = hashes[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long): a map over the scan."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batch_slices(whole, 1):
                fps = np.fromiter((fingerprint(t, size) for t in bytes_of(batch.column(1))), np.uint64, len(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


@functools.lru_cache(maxsize=256)
def flips(bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of ``bits`` low bits with at most ``most`` set, and how many each has."""
    masks = [(sum(1 << b for b in c), k) for k in range(most + 1) for c in combinations(range(bits), k)]
    return np.array([m for m, _ in masks], np.uint64), np.array([k for _, k in masks], np.int64)


def prefix_bits(n: int, radius: int = RADIUS) -> int:
    """Bits of the shuffle key for n distinct fingerprints: about ``PER_KEY`` rows in a key."""
    half, p = radius // 2, 8
    while p < 24 and n * sum(math.comb(p, k) for k in range(half + 1)) / 2 ** p > PER_KEY:
        p += 1
    return p


def collide(fp: np.ndarray, base: np.ndarray, left: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """Verified pairs (least fingerprint of a variant, another one of it). Row i has the variants
    ``base[i]`` with at most ``left[i]`` of its low ``bits`` flipped."""
    variants, owner = [], []
    for k in range(radius // 2 + 1):
        at = np.flatnonzero(left == k)
        if len(at):
            masks = flips(bits, k)[0]
            variants.append((base[at, None] ^ masks[None, :]).ravel())
            owner.append(np.repeat(at.astype(np.int32), len(masks)))
    if not variants:
        return np.zeros((0, 2), np.uint64)
    v = np.concatenate(variants)
    del variants
    ordered = np.sort(v)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return np.zeros((0, 2), np.uint64)
    place = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
    hit = np.flatnonzero(twice[place] == v)
    group, who = place[hit], fp[np.concatenate(owner)[hit]]
    order = np.lexsort((who, group))
    group, who = group[order], who[order]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    least = who[np.maximum.accumulate(np.where(head, np.arange(len(who)), 0))]
    pairs = np.unique(np.stack([least, who], 1)[~head & (least != who)], axis=0)
    return pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]


def forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs that connect what ``pairs`` connect: at most one fewer than there are fingerprints."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    keep = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append((a, b))
    return np.array(keep, np.uint64).reshape(-1, 2)


def links_of_key(fp: np.ndarray, base: np.ndarray, left: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """One key: while its variants are too many for a block, halve them by their next bit."""
    if bits <= 1 or sum(int((left == k).sum()) * len(flips(bits, k)[0]) for k in range(radius // 2 + 1)) <= BLOCK:
        return collide(fp, base, left, bits, radius)
    bit, out = np.uint64(1 << (bits - 1)), []
    for value in (np.uint64(0), bit):
        same = (base & bit) == value
        take = same | (left > 0)
        halved = np.where(same, base, base ^ bit)[take]
        out.append(links_of_key(fp[take], halved, (left - ~same)[take], bits - 1, radius))
    return forest(np.unique(np.concatenate(out), axis=0))


def links_of_block(fp: np.ndarray, key: np.ndarray, left: np.ndarray, prefix: int, radius: int) -> np.ndarray:
    """All links that the variants of some whole keys show, as a forest."""
    inner = 64 - prefix
    base = (fp & np.uint64((1 << inner) - 1)) | (key.astype(np.uint64) << np.uint64(inner))
    weight = np.array([len(flips(inner, k)[0]) for k in range(radius // 2 + 1)])
    if weight[left].sum() <= 2 * BLOCK:
        found = collide(fp, base, left, inner, radius)
    else:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
        found = np.concatenate([links_of_key(fp[s:e], base[s:e], left[s:e], inner, radius)
                                for s, e in zip(starts, [*starts[1:], len(key)])])
    return forest(np.unique(found, axis=0))


def link_rows(rows: DataFrame, prefix: int, radius: int = RADIUS) -> DataFrame:
    """a, b: verified links that connect what variants connect.

    ``rows``: fp, key (prefix of a variant), left (flips left below the prefix); the rows of a key stand
    together. They are taken in blocks of whole keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.array([len(flips(64 - prefix, k)[0]) for k in range(radius // 2 + 1)])
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def block() -> pa.RecordBatch:
            pairs = links_of_block(*(np.concatenate(x) for x in zip(*held)), prefix, radius)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy().view(np.int64)) for i in (0, 1)],
                                              names=["a", "b"])

        for batch in batches:
            fp, key, left = (batch.column(i).to_numpy() for i in range(3))
            fp, left = fp.view(np.uint64), left.astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() if len(key) else []
            for s, e in zip(starts, [*starts[1:], len(key)]):
                if size >= BLOCK and held[-1][1][-1] != key[s]:
                    yield block()
                    held, size = [], 0
                held.append((fp[s:e], key[s:e], left[s:e]))
                size += int(weight[left[s:e]].sum())
        if held:
            yield block()

    return rows.select("fp", "key", "left").mapInArrow(run, "a long, b long")


def _masks(bits: int, most: int) -> Column:
    """Array of struct(m, used): the ways to flip at most ``most`` of ``bits`` bits."""
    return F.array(*[F.struct(F.lit(int(m)).alias("m"), F.lit(int(k)).alias("used")) for m, k in zip(*flips(bits, most))])


def variant_rows(fps: DataFrame, prefix: int, radius: int = RADIUS) -> DataFrame:
    """fp, key, left: the variants of each distinct ``fp`` in compact form, native."""
    spread = fps.select("fp", F.inline(_masks(prefix, radius // 2)))
    return spread.select("fp", F.shiftrightunsigned("fp", 64 - prefix).bitwiseXOR(F.col("m")).alias("key"),
                         (F.lit(radius // 2) - F.col("used")).alias("left"))


def longer_keys(rows: DataFrame, prefix: int, step: int, radius: int = RADIUS) -> DataFrame:
    """The same variants under keys of ``prefix + step`` bits; ``rows`` as of ``variant_rows`` with ``prefix`` bits."""
    below = F.shiftrightunsigned("fp", 64 - prefix - step).bitwiseAND(F.lit((1 << step) - 1))
    spread = rows.select("fp", "key", "left", F.inline(_masks(step, radius // 2))).where("used <= left")
    return spread.select("fp", F.shiftleft("key", step).bitwiseOR(below.bitwiseXOR(F.col("m"))).alias("key"),
                         (F.col("left") - F.col("used")).alias("left"))


def hot_keys(fps: DataFrame, prefix: int, radius: int = RADIUS) -> DataFrame:
    """Keys of ``prefix`` bits with more than ``HOT_KEY`` rows. The fingerprints are counted by their own prefix
    first, so that few rows are spread over the keys around it."""
    own = fps.groupBy(F.shiftrightunsigned("fp", 64 - prefix).alias("own")).agg(F.count("*").alias("n"))
    spread = own.select("n", "own", F.inline(_masks(prefix, radius // 2)))
    return (spread.groupBy(F.col("own").bitwiseXOR(F.col("m")).alias("key")).agg(F.sum("n").alias("n"))
            .where(F.col("n") > HOT_KEY).select("key"))


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, n: int | None = None) -> DataFrame:
    """Links among the distinct values of ``fp``; ``radius`` is even, so that half of it reaches from both sides."""
    if radius % 2:
        raise ValueError("radius must be even")
    p = prefix_bits(fps.count() if n is None else n, radius)
    rows, hot, out = variant_rows(fps, p, radius), hot_keys(fps, p, radius), None
    while True:
        hot = stored(hot, "simhash-hot-keys")
        many = hot.count()
        side = F.broadcast(hot) if many <= BROADCAST_IDS else hot
        cold = rows.join(side, "key", "left_anti") if many else rows
        links = link_rows(cold.repartition("key").sortWithinPartitions("key"), p, radius)
        out = links if out is None else out.unionAll(links)
        if not many or p == 64:
            return out
        step = min(STEP, 64 - p)
        rows = stored(longer_keys(rows.join(side, "key", "left_semi"), p, step, radius), "simhash-longer-keys")
        p += step
        hot = rows.groupBy("key").count().where(F.col("count") > (HOT_KEY if p < 64 else 1 << 62)).select("key")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links)."""
    marked = stored(fingerprints(docs, size, id_col, text_col), "simhash-fingerprints")
    # one row per distinct fingerprint, partial sums before the shuffle: copies are counted once
    per_fp = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    links = stored(fingerprint_links(per_fp.select("fp"), radius), "simhash-links")
    comp = components(links)  # node, root
    rooted = stored(per_fp.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    # stored, so that both joins below shuffle plain scans and a hot component or fingerprint is split
    best = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    named = rooted.join(best, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id. If an id occurs more than
    once, its rows are dropped only if none of them is to stay; rows without an id stay."""
    found = stored(near_duplicates(docs, size, radius, id_col, text_col), "simhash-components")
    away = (F.col("doc_id") != F.col("component_id")).cast("int")
    dropped = (found.where("doc_id is not null").groupBy("doc_id").agg(F.min(away).alias("away")).where("away = 1")
               .select(F.col("doc_id").alias("__drop")))
    return without_ids(docs, dropped, id_col)
