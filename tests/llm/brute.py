"""Plain single-process versions of the operators, to compare with."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def bpe_digests(docs, tokenizer):
    out = {}
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        out[i] = (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    return out


def token_rows(docs, tokenizer, end_id=2):
    out, start = {}, 0
    for i, t in sorted(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def measures(text):
    w = words(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i:i + 8])] > 1:
            cover |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover))


def fingerprint(text):
    import xxhash
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(docs):
    """doc_id -> (fingerprint, smallest id reachable over distances of at most 4)."""
    fp = {i: fingerprint(t) for i, t in docs}
    distinct = sorted(set(fp.values()))
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(distinct, np.uint64)
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 4):
            x, y = root(f), root(distinct[i + 1 + j])
            parent[max(x, y)] = min(x, y)
    least = defaultdict(lambda: None)
    for i, f in fp.items():
        r = root(f)
        least[r] = i if least[r] is None else min(i, least[r])
    return {i: (f"{f:016x}", least[root(f)]) for i, f in fp.items()}


def exact_groups(docs):
    groups = defaultdict(list)
    for i, t in docs:
        t = t or ""
        norm = "".join(c for c in t if c not in BLANK)
        groups[norm].append((-len(t), i))
    out = {}
    for norm, rows in groups.items():
        keep = min(rows)[1]
        for _, i in rows:
            out[i] = (keep, len(rows), i == keep, sha(norm))
    return out


def packed_ids(text, tokenizer, end_id=1):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]


def chat_digests(rows):
    """rows: (conv_id, turn, role, text)"""
    out = {}
    for conv, turns in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1])), key=lambda r: r[0]):
        turns = list(turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def shards(docs, limit):
    """doc_id -> bits: the shallowest prefix of md5(id) whose documents fit; larger documents are left out."""
    bits = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest(), 16))[2:].zfill(128) for i, t in docs
            if len((t or "").encode()) <= limit}
    size = {i: len((t or "").encode()) for i, t in docs}
    out = {}

    def split(prefix, ids):
        if sum(size[i] for i in ids) <= limit:
            out.update({i: prefix for i in ids})
        else:
            for b in "01":
                split(prefix + b, [i for i in ids if bits[i].startswith(prefix + b)])

    split("", list(bits))
    return out


def repaired(rows):
    """rows: (role, text) of one conversation in order -> blank, duplicate, truncated, illegal, cost, audit, repaired rows."""
    seen, faults = set(), []
    for role, text in rows:
        stripped = text.rstrip(BLANK)
        faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else "none" if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    legal = re.compile(r"(s?(ua)+)?")

    def emits(state, initial):     # states: what has been written so far, as its last initial
        return {"": "su", "s": "u", "u": "a", "a": "u"}[state].find(initial) >= 0 if initial else False

    best = {}

    def rest(i, state, inserted):
        """Cheapest (cost, audit, rows) from row i on; at most two inserts in front of a row."""
        key = (i, state, inserted)
        if key not in best:
            found = []
            if inserted < 2:
                for r in ("user", "assistant"):
                    if emits(state, r[0]):
                        c, a, o = rest(i, r[0], inserted + 1)
                        found.append((c + 3, "I" + a, [(r, ""), *o]))
            if i == len(rows):
                if state in ("", "a"):
                    found.append((0, "", []))
            else:
                role, text = rows[i]
                c, a, o = rest(i + 1, state, 0)
                found.append((c + 4, "D" + a, o))
                if faults[i] in ("none", "truncated"):
                    extra = 3 if faults[i] == "truncated" else 0
                    for r, cost, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                        if emits(state, r[:1]):
                            c, a, o = rest(i + 1, r[0], 0)
                            found.append((c + cost + extra, edit + a, [(r, text), *o]))
            best[key] = min(found, key=lambda x: x[:2], default=(10**9, "", []))
        return best[key]

    cost, audit, out = rest(0, "", 0)
    assert legal.fullmatch("".join(r[:1] for r, _ in out))
    return (faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, out)


def structure_reports(rows):
    """rows: (conv_id, turn, role, text) after damage, no nulls but turns -> conv_id: gaps, counts, cost, audit, hash."""
    out = {}
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    for conv, own in by_conv.items():
        own.sort(key=lambda r: r[:3])
        turns = {r[1] for r in own if r[0]}
        *numbers, fixed = repaired([r[3:] for r in own])
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *numbers, sha("\n".join(f"{r}:{t}" for r, t in fixed)))
    return out


def line_dedup(docs, min_chars=40, min_docs=5):
    """doc_id -> lines, dropped lines, text that stays."""
    def key(line):
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
        return k if len(k) >= min_chars else None

    held = defaultdict(list)
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            held[k].append(-1 if i is None else i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) is None or len(held[key(x)]) < min_docs or max(held[key(x)]) == (-1 if i is None else i)]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def filter_audit(docs, labels):
    """docs: (doc_id, text, part) -> (part, order, step): kept, removed, redundant, unique, good lost, toxic lost, shapley."""
    labels = [x for x in labels if x[0] is not None]
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = words(t)
        own = {f for f, bad in (("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)),
                                ("C", 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)), ("D", any(c in "#$%&*|" for c in t)),
                                ("E", i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))) if bad}
        fails.append((part or "", i, own))
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for p, *_ in fails}:
            mine = [x for x in fails if x[0] == part]
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [x for x in mine if f in x[2] and not x[2] & before]
                out[part, order, step] = [
                    sum(not x[2] & (before | {f}) for x in mine), len(gone), sum(f in x[2] and bool(x[2] & before) for x in mine),
                    sum(x[2] == {f} for x in mine), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)]
    totals = Counter()
    for (part, order, step), v in out.items():
        totals[part, order[step - 1]] += v[1]
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}
