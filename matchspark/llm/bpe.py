"""Operator 1: BPE encoding and decoding as bounded-lookahead streaming transducers.

**Encoding.** A text is read in chunks of ``CHUNK`` characters. A chunk is cut where no later
character can change what stands before the cut (in front of a single space that follows a
non-blank character: the pre-tokenizer's pattern always starts a new word there), the pieces are
turned into words by the pre-tokenizer's pattern and the words into ids by the merge list. A word
longer than ``LONG`` characters is never held as a whole: its bytes go through a window, and a
token leaves the window as soon as it is stable, that is, at least ``lookahead`` bytes stand to its
right. ``sufficient_lookahead`` computes that number from the merge list. The memory is bounded by
the chunk, the window and a cache of words with a fixed number of entries, however long the text is.

**Sufficient lookahead.** Merges run by rank. Let two texts agree up to some byte, and compare
their merges: the first difference is a merge that needs bytes behind that point; the leftmost
differing boundary moves left over a token ``z`` only by a merge ``(z, v)`` of a *later* rank, whose
right part ``v`` starts with the left part of the merge that caused the difference before it. So a
difference travels along a chain of merges of rising rank, and the longest chain, counted in bytes, bounds
how far right a token's surroundings can matter. A boundary with that many bytes to its right is in
the tokens of every continuation, and since no merge crosses it, both sides go on separately.

**Decoding.** Ids become bytes, and a state machine of at most three pending bytes turns bytes
into text, chunk by chunk.

Defined cases: null and empty text give no ids (n_tokens 0); control strings of the vocabulary
(``added_tokens``) inside a text become their own id, as the tokenizers library does by default;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from matchspark.llm.common import CACHED_WORD, batch_slices, lists_of_int32, narrow, texts_of

CHUNK = 1 << 16       # characters read at a time
LONG = 4096           # a word that grows beyond this goes through the window
CACHED = 500_000      # entries in each of a worker's caches

# Fixed values of the byte-level scheme: the word pattern, and the bytes shown as themselves.
WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
SHOWN = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]

NEVER = 1 << 60  # the rank of a pair that does not merge

_WORDS = regex.compile(WORD_PATTERN)
_BLANK_SPACE = re.compile(r"\s ")
_RUNS = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"),
         "S": regex.compile(r"\p{White_Space}*"), "O": regex.compile(r"[^\p{White_Space}\p{L}\p{N}]*")}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, by letter: bytes that can be shown
    stand for themselves, the others follow from U+0100 on."""
    rest = [b for b in range(256) if b not in set(SHOWN)]
    return {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A byte-level merge list: ids of bytes, ranked pairs, bytes of ids, added tokens."""

    def __init__(self, letters: dict[int, int], pairs: list[tuple[int, int, int]], spelled: dict[int, bytes],
                 added: dict[str, int] | None = None):
        self.byte_id = [letters[b] for b in range(256)]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(pairs)}
        self.new = [new for _, _, new in pairs]
        self.pairs, self.spelled = pairs, spelled
        self.added = dict(added or {})
        self.lookahead = sufficient_lookahead(pairs, spelled)

    @classmethod
    def of_file(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        return cls.of_spec(spec)

    @classmethod
    def of_spec(cls, spec: dict) -> Merges:
        model, as_byte = spec["model"], byte_letters()
        spelled = {i: bytes(as_byte[c] for c in t) for t, i in model["vocab"].items()
                   if all(c in as_byte for c in t)}
        vocab = model["vocab"]
        pairs = []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.append((vocab[a], vocab[b], vocab[a + b]))
        letters = {b: vocab[c] for c, b in as_byte.items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        spelled |= {i: t.encode() for t, i in added.items()}
        return cls(letters, pairs, spelled, added)

    def tokens(self, data: bytes) -> list[int]:
        """Ids of one word: lowest rank first, leftmost first among equals."""
        ids = [self.byte_id[b] for b in data]
        return self._short(ids) if len(ids) <= 48 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        rank, new = self.rank, self.new
        ranks = [rank.get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            ids[i] = new[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), NEVER)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list: n log n."""
        n, rank = len(ids), self.rank
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]), NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.new[best], -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for left, right in ((prv[i], i), (i, nxt[i])):
                if left >= 0 and right < n and (r := rank.get((ids[left], ids[right]), NEVER)) < NEVER:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [t for t in ids if t >= 0]


def sufficient_lookahead(pairs: list[tuple[int, int, int]], spelled: dict[int, bytes]) -> int:
    """Bytes to the right of a boundary after which no continuation can remove or add it.

    ``reach[t]``: the longest way in bytes, over merges of later rank than those seen so far (the list is
    read from its end), that a difference can travel left from a token ``t``."""
    starts: dict[int, list[int]] = {}   # a token, its left part, that one's left part, ...
    reach: dict[int, int] = {}
    for a, _, new in pairs:
        starts.setdefault(new, [new, *starts.get(a, [a])])
    most = 0
    for a, b, _ in reversed(pairs):
        way = len(spelled[a]) + reach.get(a, 0)
        most = max(most, way + len(spelled[b]))
        for t in starts.get(b, [b]):
            if way > reach.get(t, 0):
                reach[t] = way
    return max(most, max((len(s) for s in spelled.values()), default=1))


class _Words(dict):
    """Little-endian ids of a word; a cache that forgets the older half, bounded in bytes: long words are not kept."""

    def __init__(self, make, size: int = CACHED):
        super().__init__()
        self.make, self.size, self.old = make, size // 2, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) > CACHED_WORD:
            return ids
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Streaming transducer from text to little-endian ids; ``feed`` chunks, then ``finish``."""

    def __init__(self, merges: Merges, window: int | None = None):
        self.merges = merges
        self.window = window or max(4 * merges.lookahead, 8192)
        self.word = _Words(lambda w: _packed(merges.tokens(w.encode())))
        self.piece = _Words(self._piece)                      # piece of text up to a cut
        self.spaced = _Words(self._spaced)                    # the same after one space
        self._start()

    def _start(self) -> None:
        self.tail, self.run, self.pending = "", None, b""

    def _piece(self, p: str) -> bytes:
        """Ids of a piece between two cuts."""
        if p[0] == "\n" and p[1:].isalpha():
            return self.word["\n"] + _packed(self.merges.tokens(p[1:].encode()))
        return self._words(p)

    def _spaced(self, p: str) -> bytes:
        """Ids of one space and ``p``, by parts already known where a boundary is certain: after a
        word of letters comes a stop, or a line break follows a character that is not blank."""
        if p.isalpha():
            return _packed(self.merges.tokens(b" " + p.encode()))
        if p[-1:] in (".", ",") and p[:-1].isalpha():
            return self.spaced[p[:-1]] + self.word[p[-1]]
        i = p.rfind("\n")
        if i > 0 and not p[i - 1].isspace():
            return self.spaced[p[:i]] + self.piece[p[i:]]
        return self._words(" " + p)

    def _words(self, p: str) -> bytes:
        return b"".join(map(self.word.__getitem__, _WORDS.findall(p)))

    def encode(self, text: str) -> bytes:
        out = [self.feed(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)]
        out.append(self.finish())
        return b"".join(out)

    def feed(self, chunk: str) -> bytes:
        """Ids that no later text can change."""
        buf, out, done = self.tail + chunk, [], 0
        self.tail = ""
        first = {s: i for s in self.merges.added if (i := buf.find(s)) >= 0}
        while first:
            at, special = min((i, s) for s, i in first.items())
            out += [self._text(buf[done:at]), self._end(), _packed([self.merges.added[special]])]
            done = at + len(special)
            first = {s: j for s, i in first.items() if (j := i if i >= done else buf.find(s, done)) >= 0}
        buf = buf[done:]
        hold = max((k for s in self.merges.added for k in range(1, len(s)) if buf.endswith(s[:k])), default=0)
        held = buf[len(buf) - hold:] if hold else ""
        out.append(self._text(buf[:len(buf) - hold] if hold else buf))
        self.tail += held
        return b"".join(out)

    def _text(self, buf: str) -> bytes:
        """Settled ids of ``buf``; what may still change goes to ``tail``, ``run`` or ``pending``."""
        out = []
        if self.run:
            ids, buf = self._continue(buf)
            out.append(ids)
            if self.run:
                return b"".join(out)
        cut = len(buf)
        while (cut := buf.rfind(" ", 0, cut)) > 0 and _BLANK_SPACE.match(buf, cut - 1):
            pass
        if cut > 0:
            out.append(self._settled(buf[:cut]))
            buf = buf[cut:]
        if len(buf) <= LONG:
            self.tail = buf
            return b"".join(out)
        words = _WORDS.findall(buf)
        for w in words[:-2]:
            out.append(self.word[w] if len(w) <= LONG else self._whole(w))
        rest = words[-2:]
        if len(rest[-1]) > LONG:
            out += [self.word[w] if len(w) <= LONG else self._whole(w) for w in rest[:-1]]
            out.append(self._open(rest[-1]))
        else:
            out += [self._whole(w) for w in rest[:-1] if len(w) > LONG]
            self.tail = "".join(w for w in rest if len(w) <= LONG or w is rest[-1])
        return b"".join(out)

    def _settled(self, text: str) -> bytes:
        if _BLANK_SPACE.search(text) is None:
            first, *more = text.split(" ")
            if len(text) < LONG or max(map(len, more), default=0) < LONG > len(first):
                return (self.piece[first] if first else b"") + b"".join(map(self.spaced.__getitem__, more))
        return b"".join([self.word[w] if len(w) <= LONG else self._whole(w) for w in _WORDS.findall(text)])

    def _whole(self, word: str) -> bytes:
        """A long word whose end is known."""
        self.pending = b""
        return self._push(word) + self._close()

    def _open(self, word: str) -> bytes:
        """Begin a long word; a run of blanks keeps its last character back."""
        c = word[1] if word[0] == " " and len(word) > 1 else word[0]
        self.run = next(k for k, r in _RUNS.items() if r.match(c).end())
        self.pending = b""
        if self.run == "S":
            self.tail = word[-1]
            word = word[:-1]
        return self._push(word)

    def _continue(self, buf: str) -> tuple[bytes, str]:
        end = _RUNS[self.run].match(buf).end()
        part, rest = buf[:end], buf[end:]
        if self.run == "S":  # the last blank belongs to what follows
            if not rest:
                self.tail = part[-1:]
                return self._push(part[:-1]), ""
            return self._push(part[:-1]) + self._close(), part[-1:] + rest
        ids = self._push(part)
        if rest:
            ids += self._close()
        return ids, rest

    def _push(self, part: str) -> bytes:
        out = []
        data = part.encode()
        for i in range(0, len(data), self.window):
            self.pending += data[i:i + self.window]
            if len(self.pending) >= 2 * self.window:
                out.append(self._emit(len(self.pending) - self.merges.lookahead))
        return b"".join(out)

    def _emit(self, upto: int) -> bytes:
        """Tokens of the window that end at byte ``upto`` or before: they are stable."""
        done, ids = 0, []
        for t in self.merges.tokens(self.pending):
            n = len(self.merges.spelled[t])
            if done + n > upto:
                break
            done += n
            ids.append(t)
        self.pending = self.pending[done:]
        return _packed(ids)

    def _close(self) -> bytes:
        ids = _packed(self.merges.tokens(self.pending))
        self.run, self.pending = None, b""
        return ids

    def finish(self) -> bytes:
        out = self._end()
        self._start()
        return out

    def _end(self) -> bytes:
        """All that is still open, at the end of a text or in front of an added token."""
        out = b""
        tail, self.tail = self.tail, ""
        if self.run:
            end = _RUNS[self.run].match(tail).end()
            if end == len(tail):
                out, tail = self._push(tail) + self._close(), ""
            else:
                out, tail = self._continue(tail)
        return out + (self._settled(tail) if tail else b"")


class Decoder:
    """Streaming transducer from ids to text: a state of at most three pending bytes."""

    def __init__(self, merges: Merges):
        self.spelled = [merges.spelled.get(i, b"") for i in range(max(merges.spelled) + 1)]
        self.pending = b""

    def feed(self, ids) -> str:
        data = self.pending + b"".join(map(self.spelled.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            b = data[-back]
            if b >= 0xC0:  # a lead byte: whole only if its continuation bytes are there
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                cut -= back if need > back else 0
                break
            if b < 0x80:
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        last, self.pending = self.pending, b""
        return last.decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(Merges.of_file(path))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): every whole text by the byte-level merge list in ``path``.

    A map over the scan, no shuffle. ``path`` must be readable on the executors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in batch_slices(whole, 1):
                ids = [enc.encode(t) for t in texts_of(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists_of_int32(ids)], names=["doc_id", "ids"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids",
               chunk: int = 1 << 14) -> DataFrame:
    """doc_id, text: the ids of each row back to text, ``chunk`` ids at a time (null ids: empty)."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from matchspark.llm.common import int32_lists
        dec = Decoder(encoder(path).merges)
        for batch in batches:
            texts = []
            for view in int32_lists(batch.column(1)):
                ids = np.frombuffer(view, "<i4")
                texts.append("".join([*(dec.feed(ids[i:i + chunk].tolist()) for i in range(0, len(ids), chunk)),
                                      dec.finish()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, "doc_id long, text string")
