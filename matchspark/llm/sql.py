"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from matchspark.llm import quality_rules as rules
from matchspark.llm.sharding import QUERY_LIMIT as SHARD_BYTES

ORACLE: dict[str, str] = {}

_BLANK = r"[\x20\x09-\x0D]"

ORACLE["op8_exact_dedup"] = f"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, min(doc_id) FILTER (WHERE n = most) AS keep_id
  FROM (SELECT *, max(n) OVER (PARTITION BY text_sha256) AS most FROM t) GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

ORACLE["op4_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<s>[INST] ') + length(regexp_replace(role, '[<\[\\\n]', '..', 'g')) + 1
           + length(regexp_replace(text, '[<\[\\]', '..', 'g')) + length(' [/INST]</s>') + 1)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

# the bits of md5(doc_id); a document's bucket is its shallowest prefix whose documents fit
_BITS = " || ".join(f"lpad(bin(('0x' || substr(k, {1 + 8 * i}, 8))::BIGINT), 32, '0')" for i in range(4))
ORACLE["op5_extendible_sharding"] = f"""
WITH k AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes, md5(coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
d AS (SELECT doc_id, bytes, {_BITS} AS bits FROM k WHERE bytes <= {SHARD_BYTES}),
p AS (SELECT doc_id, bytes, depth, substr(bits, 1, depth) AS shard FROM d, generate_series(0, 40) AS s(depth)),
b AS (SELECT *, sum(bytes) OVER (PARTITION BY shard) AS shard_bytes FROM p)
SELECT doc_id, any_value(bytes) AS bytes, arg_min(shard, depth) AS shard, arg_min(shard_bytes, depth)::BIGINT AS shard_bytes
FROM b WHERE shard_bytes <= {SHARD_BYTES} GROUP BY doc_id
UNION ALL
SELECT doc_id, bytes, '!' || md5(k || ':' || '0'), bytes FROM k WHERE bytes > {SHARD_BYTES}
"""


def _steps() -> str:
    """One row per document and rule: its step."""
    return " UNION ALL ".join(
        f"SELECT doc_id, stratum, '{rule}' AS rule, {cuts} AS cutoffs, "
        f"least({cuts}, CASE WHEN {den} > 0 THEN ({steps} * ({num})) // {den} ELSE 0 END)::INT AS step FROM m"
        for rule, (num, den, steps, cuts) in rules.RULES.items())


_ALPHA = rules.ALPHA / len(rules.RULES)
ORACLE["op3_quality_rules"] = f"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) > 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM twice, generate_series(0, 7) AS s(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, stratum, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - list_unique(lines))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, list_unique(words)::BIGINT AS n_distinct,
         md5(translate(text, '{rules.UPPER}' || chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '{rules.UPPER.lower()}')) AS copy
  FROM w LEFT JOIN rep USING (doc_id)),
base AS (SELECT doc_id, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed FROM m),
steps AS ({_steps()}),
truth AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
once AS (
  SELECT min(m.doc_id) AS doc_id, quality FROM m JOIN base USING (doc_id) JOIN truth USING (doc_id)
  WHERE NOT base_failed GROUP BY stratum, copy, quality),
held AS (SELECT stratum, rule, cutoffs, step, quality FROM steps JOIN once USING (doc_id)),
tests AS (SELECT {len(rules.RULES)} * greatest(1, count(DISTINCT stratum)) AS n FROM held),
cuts AS (
  SELECT stratum, rule, j,
         count(*) FILTER (WHERE quality = 1) AS n_good,
         count(*) FILTER (WHERE quality = 1 AND step >= j) AS good, count(*) FILTER (WHERE quality = 0 AND step >= j) AS bad
  FROM held, generate_series(1, 50) AS s(j) WHERE j <= cutoffs GROUP BY stratum, rule, j),
tails AS (
  SELECT stratum, rule, j, good, bad,
         CASE WHEN n_good = 0 OR good >= n_good * {_ALPHA} THEN 1.0 ELSE list_sum(list_transform(generate_series(0, good),
           lambda i: exp(lgamma(n_good + 1.0) - lgamma(i + 1.0) - lgamma(n_good - i + 1.0) + i * ln({_ALPHA}) + (n_good - i) * ln(1 - {_ALPHA})))) END AS p
  FROM cuts),
certified AS (
  SELECT *, bool_and(p <= {rules.DELTA} / (SELECT n FROM tests)) OVER (PARTITION BY stratum, rule ORDER BY j DESC) AS ok FROM tails),
chosen AS (
  SELECT stratum, rule, arg_max(j, (bad - {rules.GOOD_COST} * good) * 1000 + j) AS cutoff
  FROM certified WHERE ok AND bad - {rules.GOOD_COST} * good > 0 GROUP BY stratum, rule),
rejected AS (SELECT DISTINCT doc_id FROM steps JOIN chosen USING (stratum, rule) WHERE step >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r.doc_id IS NULL AS kept, n_lines, n_distinct
FROM m JOIN base USING (doc_id) LEFT JOIN rejected r USING (doc_id)
"""

_STRIPPED = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
ORACLE["op12_line_dedup"] = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate({_STRIPPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keep_id <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keep_id IS NULL OR keep_id = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
"""

ORACLE["op13_filter_audit"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM t GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 100)::INT + 2 * (100 * list_unique(words) < 80 * len(words))::INT
         + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS fails
  FROM t JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letter(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, bit,
         (SELECT sum(l2.bit) FROM letter l2 WHERE contains(substr(filter_order, 1, step - 1), l2.x)) AS earlier
  FROM orders, generate_series(1, 5) AS s(step), letter WHERE x = substr(filter_order, step, 1)),
m AS (
  SELECT part, filter_order, step, s.bit,
         sum(n) FILTER (WHERE fails & (coalesce(earlier, 0) | s.bit)::INT = 0) AS kept,
         sum(n) FILTER (WHERE fails & coalesce(earlier, 0)::INT = 0 AND fails & s.bit > 0) AS removed,
         sum(n) FILTER (WHERE fails & coalesce(earlier, 0)::INT > 0 AND fails & s.bit > 0) AS redundant,
         sum(n) FILTER (WHERE fails = s.bit) AS unique_fails,
         sum(good) FILTER (WHERE fails & coalesce(earlier, 0)::INT = 0 AND fails & s.bit > 0) AS good_lost,
         sum(toxic) FILTER (WHERE fails & coalesce(earlier, 0)::INT = 0 AND fails & s.bit > 0) AS toxic_lost
  FROM c, steps s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM m
"""

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a; inserts lead from a state to another, then the row is edited
_INSERTS = """(VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 3, 'I', 'user:|'), (1, 2, 3, 'I', 'user:|'), (3, 2, 3, 'I', 'user:|'), (2, 3, 3, 'I', 'assistant:|'),
  (0, 3, 6, 'II', 'user:|assistant:|'), (1, 3, 6, 'II', 'user:|assistant:|')) AS ins(a, b, icost, iaudit, itext)"""
_EDITS = """(VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) AS em(e, b, c)"""
ORACLE["op11_structure_repair"] = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (
  SELECT k, xor(list_reduce(list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT),
         lambda c, b: list_reduce(range(8)::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
  FROM (SELECT DISTINCT k FROM src)),
damage AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src JOIN crc USING (k)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text), copy) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends FROM damage),
faults AS (
  SELECT *, substr(role, 1, 1) AS initial,
         CASE WHEN ends = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN right(ends, 1) IN ('.', '!', '?') THEN 'n' ELSE 't' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
edits AS (
  SELECT conv_id, i, b, c, cost, audit, out FROM (
    SELECT conv_id, i, s.b, s.b AS c, 4 AS cost, 'D' AS audit, '' AS out FROM faults, (VALUES (0), (1), (2), (3)) AS s(b)
    UNION ALL
    SELECT conv_id, i, em.b, em.c, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K', role || ':' || text || chr(10)
    FROM faults JOIN {_EDITS} ON em.e = initial WHERE fault IN ('n', 't')
    UNION ALL
    SELECT conv_id, i, em.b, em.c, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', CASE em.e WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10)
    FROM faults JOIN {_EDITS} ON em.e IN ('u', 'a') WHERE fault IN ('n', 't'))),
moves AS (
  SELECT conv_id, i, ins.a, e.c, min(struct_pack(cost := icost + e.cost, audit := iaudit || e.audit, out := replace(itext, '|', chr(10)) || e.out)) AS m
  FROM edits e JOIN {_INSERTS} ON ins.b = e.b GROUP BY conv_id, i, ins.a, e.c),
walk(conv_id, i, state, p) AS (
  SELECT conv_id, 0::BIGINT, 0, struct_pack(cost := 0, audit := '', out := '') FROM ids
  UNION ALL
  SELECT w.conv_id, v.i, v.c, min(struct_pack(cost := w.p.cost + v.m.cost, audit := w.p.audit || v.m.audit, out := w.p.out || v.m.out))
  FROM walk w JOIN moves v ON v.conv_id IS NOT DISTINCT FROM w.conv_id AND v.i = w.i + 1 AND v.a = w.state GROUP BY w.conv_id, v.i, v.c),
done AS (
  SELECT w.conv_id, min(struct_pack(cost := w.p.cost + icost, audit := w.p.audit || iaudit, out := w.p.out || replace(itext, '|', chr(10)))) AS p
  FROM walk w LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id JOIN {_INSERTS} ON ins.a = w.state
  WHERE w.i = coalesce(n.n, 0) AND ins.b IN (0, 3) GROUP BY w.conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, d.p.cost::BIGINT AS cost, d.p.audit AS audit, sha256(d.p.out[:-2]) AS repaired_sha256
FROM done d LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM d.conv_id
"""
