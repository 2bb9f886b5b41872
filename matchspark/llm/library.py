"""Encoding by the ``tokenizers`` library, asked once per distinct word of a batch.

A text is cut only where its words cannot influence each other under the file's own
pre-tokenizer; the library encodes the distinct pieces, a bounded cache keeps their ids. Where the
file or the text doesn't allow a cut, the library gets the whole text. The ids are those of
encoding each whole text.

* ``spaces``: a byte-level pre-tokenizer that attaches one space to the word behind it. A piece
  starts at a space after a character that is not blank. In plain texts (no two blanks in a row) a line
  break, and a stop or comma after a letter or digit, are pieces of their own.
* ``blanks``: a normalizer that collapses blanks and a pre-tokenizer that drops them. Pieces are
  separated by ASCII blanks (others stay inside a piece, for the library to drop); in plain texts a
  stop or comma after a letter or digit starts a piece.
* ``whole``: anything else.

Distinct words of letters are joined to longer strings for the library, which is faster than
many short ones; each is one word of the pre-tokenizer, and its first id (``spaces``: the only one that
starts with a space) or last id (``blanks``: the only one that ends a word) tells them apart.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from matchspark.llm.common import CACHED_WORD

CACHED = 300_000  # entries in each of the two halves of a worker's cache
JOINED = 50       # words in one string for the library
BARE = "\x02"     # marks a piece that has no space before it

# A stop or comma may be cut off only behind a letter or digit; İ is lowered to a letter and a mark.
# The patterns start with a set of rare characters, which is the fastest search.
_ODD_BLANKS = re.compile(r"[.,\x1c-\x1fİ](?<![^\W_][.,])")
_ODD_SPACES = re.compile(r"[.,\x02\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000](?<![^\W_][.,])")
_TWO_BLANKS = ("  ", "\n ", " \n", "\n\n")
_BLANK_SPACE = re.compile(r"\s |\x02")


def _steps(part: dict | None, key: str) -> list[dict]:
    return [] if part is None else part[key] if key in part else [part]


def cutting(spec: dict) -> str:
    """How texts may be cut under a tokenizer file: ``spaces``, ``blanks`` or ``whole``."""
    before, norm = _steps(spec.get("pre_tokenizer"), "pretokenizers"), _steps(spec.get("normalizer"), "normalizers")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")
           for t in spec.get("added_tokens", [])):
        return "whole"
    if not norm and len(before) == 1 and before[0]["type"] == "ByteLevel" and before[0].get("use_regex", True) \
            and not before[0].get("add_prefix_space"):
        return "spaces"
    if {n["type"] for n in norm} <= {"NFC", "Replace", "Lowercase"} \
            and any(n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in norm) \
            and before and before[0]["type"] == "Split" and before[0]["behavior"] == "Removed" and before[0]["invert"] \
            and "[\\p{L}]+" in before[0]["pattern"]["Regex"] \
            and "\\s" not in before[0]["pattern"]["Regex"].replace("[^\\s", "") \
            and spec["model"].get("end_of_word_suffix"):
        return "blanks"
    return "whole"


class LibraryEncoder:
    """Little-endian ids of texts; one per Python worker."""

    def __init__(self, path: str, cached: int = CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut = cutting(spec)
        if self.cut != "whole":  # words are asked once: the library's own cache of words would only cost
            self.tokenizer.model._resize_cache(0)
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)  # ids that start (spaces) or end (blanks) a word
        mark = spec["model"].get("end_of_word_suffix") or "Ġ"
        for t, i in vocab.items():
            self.edge[i] = t.endswith(mark) if self.cut == "blanks" else t.startswith(mark)
        self.line_break = vocab.get("Ċ", -1)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached = cached

    # ---- cutting -------------------------------------------------------------------------

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces whose ids, one after the other, are those of the text; None: it can't be cut."""
        if self.cut == "blanks":
            if _ODD_BLANKS.search(text) is None:
                return text.replace(",", " ,").replace(".", " .").split()
            return [p.decode() for p in text.encode().split()]
        if _ODD_SPACES.search(text) is None and not any(b in text for b in _TWO_BLANKS):
            text = text.replace(",", " \x02,").replace(".", " \x02.").replace("\n", " \x02\n \x02")
        elif _BLANK_SPACE.search(text):
            return None
        return (BARE + text).split(" ")

    # ---- asking --------------------------------------------------------------------------

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters, joined."""
        space = " " if self.cut == "spaces" else ""
        joined = [space + " ".join(words[i:i + JOINED]) for i in range(0, len(words), JOINED)]
        parts = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return self._strings([space + w for w in words])
        ends = [*at[1:].tolist(), len(ids)] if self.cut == "spaces" else (at + 1).tolist()
        return _sliced(ids, ends)

    def _bare_letters(self, words: list[str]) -> list[bytes]:
        """``spaces``: words of letters without a space before them, one to a line."""
        joined = ["\n".join(words[i:i + JOINED]) + "\n" for i in range(0, len(words), JOINED)]
        parts = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        breaks = ids == self.line_break
        ends = np.flatnonzero(breaks) - np.arange(int(breaks.sum()))
        return _sliced(ids[~breaks], ends.tolist()) if len(ends) == len(words) else self._strings(words)

    def _strings(self, strings: list[str]) -> list[bytes]:
        """Any short strings; each counts as a text of its own."""
        if not strings:
            return []
        e = self.tokenizer.encode(strings, is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(strings)), "right")
        return _sliced(np.array(e.ids, "<u4"), ends.tolist())

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the newer half of the cache lacks; they go there."""
        older, found, letters, bare, others = self.older, {}, [], [], []
        for p in pieces:
            if (ids := older.get(p)) is not None:
                found[p] = ids
            elif p.isalpha() and "İ" not in p:
                letters.append(p)
            elif self.cut == "spaces" and p[:1] == BARE and p[1:].isalpha():
                bare.append(p)
            else:
                others.append(p)
        letters.sort()  # neighbours take the same ways through the merges
        found.update(zip(letters, self._letters(letters)))
        if bare:
            bare.sort()
            found.update(zip(bare, self._bare_letters([p[1:] for p in bare])))
        asked = others if self.cut == "blanks" else [p[1:] if p[:1] == BARE else " " + p for p in others]
        found.update(zip(others, self._strings(asked)))
        if len(self.known) + len(found) > self.cached:
            self.older, self.known = self.known, {}
        self.known.update((p, ids) for p, ids in found.items() if len(p) <= CACHED_WORD)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text."""
        if self.cut == "whole":
            return self._whole(texts)
        out: list[bytes | None] = [None] * len(texts)
        whole, waiting, new = [], [], set()
        look = self.known.get
        for n, text in enumerate(texts):
            pieces = self._pieces(text)
            if pieces is None:
                whole.append(n)
                continue
            ids = list(map(look, pieces))
            if None not in ids:
                out[n] = b"".join(ids)
                continue
            gaps = [i for i, x in enumerate(ids) if x is None]
            missing = [pieces[i] for i in gaps]
            new.update(missing)
            waiting.append((n, ids, gaps, missing))
        found = self._learn(new)
        for n, ids, gaps, missing in waiting:
            for i, p in zip(gaps, missing):
                ids[i] = found[p]
            out[n] = b"".join(ids)
        for n, ids in zip(whole, self._whole([texts[n] for n in whole])):
            out[n] = ids
        return out


def _sliced(ids: np.ndarray, ends: list[int]) -> list[bytes]:
    data, out, start = ids.tobytes(), [], 0
    for end in ends:
        out.append(data[4 * start:4 * end])
        start = end
    return out


@functools.lru_cache(maxsize=1)
def library_encoder(path: str, cached: int = CACHED) -> LibraryEncoder:
    """One per Python worker, the last file and cache size asked for."""
    return LibraryEncoder(path, cached)

