"""Text functions of the ingest step, as JVM-side Column expressions.

Python-compatible details that matter for equal results:
* "strip" removes every character Python's ``str.isspace()`` accepts (Spark ``trim`` only
  removes spaces), via a character class generated from that rule.
* Word boundaries for short dictionary entries follow Python's Unicode ``\\b``: a word
  character is a letter, a digit or ``_``; the boundary test depends on whether the entry
  starts / ends with a word character.
* Accent folding (company e-mail) uses a translate table generated from Unicode NFD: every
  character whose decomposition is an ASCII letter/digit followed by combining marks maps to
  that letter; characters without such a decomposition (e.g. "Đ") are later removed.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ranges(chars: list[int]) -> str:
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        a, b = chars[i], chars[j]
        out.append(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}")
        i = j + 1
    return "".join(out)


# Rule: the characters Python treats as whitespace (str.isspace) in the BMP.
WS_CHARS = "".join(chr(i) for i in range(0x10000) if chr(i).isspace())
WS_CLASS = "[" + _ranges([ord(c) for c in WS_CHARS]) + "]"
WORD_CLASS = r"[\pL\pN_]"
NON_WORD_CLASS = r"[^\pL\pN_]"


def py_strip(c) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def is_blank(c) -> Column:
    """NULL, empty or only whitespace."""
    return F.coalesce(py_strip(c) == "", F.lit(True))


# Item delimiters of the split rule.
ITEM_DELIMITERS = ["\n", ";", ",", "•", "-", "●"]
SPLIT_PATTERN = "[" + "".join(re.escape(d) if d != "\n" else "\n" for d in ITEM_DELIMITERS) + "]"


def split_items(c) -> Column:
    """Split on every delimiter, strip, keep items longer than 2 characters (code points)."""
    parts = F.split(F.coalesce(_c(c), F.lit("")), SPLIT_PATTERN, -1)
    return F.filter(F.transform(parts, py_strip), lambda x: F.length(x) > 2)


def word_pattern(entry_lower: str) -> str:
    """Regex equal to Python's ``\\b<entry>\\b`` search (engine-neutral, no lookarounds)."""
    def isword(ch: str) -> bool:
        return ch.isalnum() or ch == "_"
    pre = f"(^|{NON_WORD_CLASS})" if isword(entry_lower[0]) else WORD_CLASS
    post = f"($|{NON_WORD_CLASS})" if isword(entry_lower[-1]) else WORD_CLASS
    return pre + re.escape(entry_lower).replace("\\ ", " ") + post


DICTIONARY_SCHEMA = "array<struct<skill:string,low:string,whole:string>>"


def _entry(skill: str) -> dict:
    low = skill.lower()
    return {"skill": skill, "low": low, "whole": word_pattern(low) if len(skill) <= 2 else None}


def extract_skills(text, dictionary: list[str], limit: int | None = None) -> Column:
    """Dictionary entries found in the text, in dictionary order (at most ``limit`` if given).

    Entries of at most 2 characters must stand as whole words; longer ones match as plain
    lower-case substrings ("java" is found inside "javascript"). Duplicate entries count once.
    For lists written into a program: the dictionary is one literal array. Dictionary tables are matched by
    ``operators.dictionary.dictionary_matches``, by the same rule.
    """
    entries = [_entry(s) for s in dict.fromkeys(dictionary) if s]
    listed = F.from_json(F.lit(json.dumps(entries)), DICTIONARY_SCHEMA)  # folded to one literal

    def scan(row: Column) -> Column:
        t = row["text"]
        # A whole-word hit needs the substring: the cheap byte search gates the regex.
        hits = F.filter(row["entries"], lambda e: t.contains(e["low"])
                        & (e["whole"].isNull() | F.regexp_like(t, F.coalesce(e["whole"], F.lit("")))))
        names = F.transform(hits, lambda e: e["skill"])
        return names if limit is None else F.slice(names, 1, limit)

    # Bind the lower-cased text once per row (lambda variable), then run every entry test on it.
    lowered = F.array(F.struct(F.lower(F.coalesce(_c(text), F.lit(""))).alias("text"), listed.alias("entries")))
    return F.coalesce(F.element_at(F.transform(lowered, scan), 1), F.array().cast("array<string>"))


def map_enum(value, mapping: dict[str, str], default: str | None = None) -> Column:
    """Lower-cased, stripped exact lookup; empty / unknown -> default."""
    v = _c(value)
    kv = []
    for k, val in mapping.items():
        kv += [F.lit(k), F.lit(val)]
    hit = F.try_element_at(F.create_map(*kv), F.lower(py_strip(v)))
    d = F.lit(default) if default is not None else F.lit(None).cast("string")
    return F.when(v.isNull() | (v == ""), d).otherwise(F.coalesce(hit, d))


def map_contains_first(value, ordered: list[tuple[str, str]]) -> Column:
    """First mapping key contained in the value (mapping order); NULL if none / empty."""
    v = _c(value)
    expr = F.lit(None).cast("string")
    for k, val in reversed(ordered):
        expr = F.when(v.contains(F.lit(k)), F.lit(val)).otherwise(expr)
    return F.when(v.isNull() | (v == ""), F.lit(None).cast("string")).otherwise(expr)


def _fold_table() -> tuple[str, str]:
    src, dst = [], []
    for i in range(0x80, 0x10000):
        ch = chr(i)
        if 0xD800 <= i <= 0xDFFF:
            continue
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and d[0].isascii() and d[0].isalnum() and all(
                unicodedata.category(x) == "Mn" for x in d[1:]):
            src.append(ch)
            dst.append(d[0])
    return "".join(src), "".join(dst)


FOLD_SRC, FOLD_DST = _fold_table()
MN_CLASS = r"\p{Mn}"  # Unicode general category "nonspacing mark"


def strip_accents(c) -> Column:
    """NFD, then drop combining marks (characters without a decomposition are kept)."""
    return F.regexp_replace(F.translate(_c(c), FOLD_SRC, FOLD_DST), MN_CLASS, "")


def company_email(name, domain: str = "gmail.com", fallback: str = "company") -> Column:
    """Company name -> e-mail: fold accents, keep ASCII letters/digits/whitespace, lower-case,
    spaces -> '.', collapse dot runs, trim dots; empty -> fallback."""
    ascii_ = F.regexp_replace(strip_accents(name), f"[^a-zA-Z0-9{WS_CLASS[1:-1]}]", "")
    dotted = F.regexp_replace(F.replace(F.lower(ascii_), F.lit(" "), F.lit(".")), r"\.+", ".")
    prefix = F.regexp_replace(dotted, r"^\.+|\.+$", "")
    # Bind the prefix once per row (used by the test and the result).
    return F.element_at(F.transform(F.array(prefix), lambda p: F.when(
        F.coalesce(p, F.lit("")) == "", F.lit(f"{fallback}@{domain}")).otherwise(F.concat(p, F.lit(f"@{domain}")))), 1)


# Texts meaning "salary negotiable".
NEGOTIABLE = ("thỏa thuận", "negotiable", "")


def parse_salary(s) -> Column:
    """STRUCT(min DECIMAL(12,2), max DECIMAL(12,2), negotiable BOOLEAN, overflow BOOLEAN).

    Commas and spaces removed, first two digit runs = (min, max), one run = both, none or a
    negotiable text = (NULL, NULL, true). ``overflow`` flags digit runs too long for the type.
    """
    v = _c(s)
    nums = F.regexp_extract_all(F.regexp_replace(F.coalesce(v, F.lit("")), "[, ]", ""), F.lit(r"(\d+)"), 1)
    n = F.size(nums)
    first = F.get(nums, 0).try_cast("decimal(12,2)")
    second = F.get(nums, 1).try_cast("decimal(12,2)")
    neg_text = v.isNull() | F.lower(v).isin(*NEGOTIABLE)
    lo = F.when(neg_text | (n == 0), F.lit(None)).otherwise(first)
    hi = F.when(neg_text | (n == 0), F.lit(None)).when(n == 1, first).otherwise(second)
    overflow = ~neg_text & (((n >= 1) & first.isNull()) | ((n >= 2) & second.isNull()))
    return F.struct(lo.cast("decimal(12,2)").alias("min_amount"), hi.cast("decimal(12,2)").alias("max_amount"),
                    (neg_text | (n == 0)).alias("is_negotiable"), overflow.alias("overflow"))


def has_salary_row(parsed) -> Column:
    """A salary row exists when min or max is non-zero, or the salary is negotiable."""
    p = _c(parsed)
    return (F.coalesce(p["min_amount"], F.lit(0)) != 0) | (F.coalesce(p["max_amount"], F.lit(0)) != 0) \
        | p["is_negotiable"]


def parse_deadline(s) -> Column:
    """``D/M/YYYY`` first, then ``YYYY-M-D``; anything else -> NULL (stripped input)."""
    v = py_strip(_c(s))
    dmy = F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(v, F.lit("d/M/yyyy")))
    ymd = F.when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(v, F.lit("yyyy-M-d")))
    return F.coalesce(dmy, ymd)


def truncate(c, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def labelled_summary(parts: list[tuple[str, Column]], sep: str = ". ") -> Column:
    """Join "label + value" for every non-empty value with ``sep``; NULL when none."""
    items = [F.when(F.coalesce(_c(v), F.lit("")) != "", F.concat(F.lit(label), _c(v))) for label, v in parts]
    return F.nullif(F.concat_ws(sep, *items), F.lit(""))


def email_for_user(userid) -> Column:
    return F.format_string("user_%s@imported.local", _c(userid))


if sys.maxunicode < 0x10000:  # pragma: no cover
    raise RuntimeError("wide unicode build required")
