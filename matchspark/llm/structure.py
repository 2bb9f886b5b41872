r"""Operator 11: conversation structure repair by a grammar-compressed dynamic program.

A repaired conversation has the role initials ``(s?(ua)+)?``. Every row has a first fault: blank (no ``[^\x20\x09-\x0D]``),
duplicate (its role and text occur earlier in the conversation), truncated (its last such character is not ``.``, ``!`` or ``?``), or none.
Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4 (the only edit of blank and duplicate rows), Insert an empty user or
assistant row anywhere 3; a truncated row that stays adds 3. Among the cheapest edits those whose initials, in order, are least in ASCII are taken.

1. ``marks``: one narrow row per turn (no text: a digest, the role's initial, the fault), stored. First occurrences come from one
   aggregate per (conversation, digest), so a turn that is repeated without end is a few rows.
2. The marks are range-partitioned by (conversation, turn, digest, row) and sorted, so a conversation of any length spans
   several tasks; runs of ``CHUNK`` turns become strings of one symbol a turn, stored.
3. Re-Pair over all strings: each round counts adjacent pairs of symbols in Spark and gives the most frequent pairs that cannot
   overlap (left and right symbols disjoint) a symbol of their own. A rule's transfer matrix (4 x 4 states: nothing yet, after s, after
   u, after a; min-plus, with the audit as a rope of its two parts) is built once, bottom-up from the two matrices
   below it, and is shared by every conversation in which the rule occurs.
4. Chunks (compressed) and texts meet once, by conversation, sorted; the chunks come first and give the audit, then the turns stream
   by and are repaired. What is held is one byte per turn of one conversation (the audit is one value) and one Arrow batch.

``MOST_RULES``, ``ROUNDS`` and ``CHUNK`` bound the work of the grammar, not the result: what no rule covers is evaluated symbol by symbol.

Defined cases: a null role or text is one space; a role without any character is like an unknown one (its initial is
never legal); turns that tie are ordered by the SHA-256 of role and text, equal rows are repeats; null turns come first; a null conv_id is a
conversation of its own; a conversation without rows has zeros, an empty audit and no repaired rows; a text of any length
streams through as one row; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import batch_slices, collected, stored

BLANK = " \t\n\x0b\x0c\r"
CHUNK = 1024
MOST_RULES = 256
ROUNDS = 10
LEAST_PAIRS = 2
INITIALS, FAULTS = "suao", ("none", "blank", "duplicate", "truncated")
SYMBOLS = "ABCDEFGHIJKLMNOP"                       # 4 * initial + fault
# rows that must go are one symbol for the dynamic program, whatever their role and fault
TERMINAL = {ord(c): "X" if FAULTS[i % 4] in ("blank", "duplicate") else c for i, c in enumerate(SYMBOLS)}
FIRST_RULE = 0xE000                                # private use: one character per rule
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
ENDS = (START, AFTER_A)
ROLES = {"u": "user", "a": "assistant"}
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
OUT = "conv_id long, at long, edit string, role string, text string, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string"


class Ropes:
    """Strings as binary trees that share their parts; node 0 is the empty string."""

    def __init__(self):
        self.left, self.right, self.leaf, self._texts = [0], [0], [""], {}

    def of(self, text: str) -> int:
        if not text:
            return 0
        self.left.append(0), self.right.append(0), self.leaf.append(text)
        return len(self.leaf) - 1

    def cat(self, a: int, b: int) -> int:
        if not a or not b:
            return a or b
        self.left.append(a), self.right.append(b), self.leaf.append("")
        return len(self.leaf) - 1

    def less(self, p: tuple[int, ...], q: tuple[int, ...]) -> bool:
        """Whether the string of the ropes ``p`` in a row is less than that of ``q``; a part both share at the same place is passed over whole."""
        a, b, x, y = [n for n in reversed(p) if n], [n for n in reversed(q) if n], "", ""
        while True:
            if not x and not y and a and b and a[-1] == b[-1]:
                a.pop(), b.pop()
                continue
            x, y = x or self._leaf(a), y or self._leaf(b)
            if not x or not y:
                return not x and bool(y)
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            x, y = x[n:], y[n:]

    def _leaf(self, stack: list[int]) -> str:
        while stack:
            n = stack.pop()
            if self.leaf[n]:
                return self.leaf[n]
            if n:
                stack += [self.right[n], self.left[n]]
        return ""

    def text(self, n: int) -> str:
        if n not in self._texts:
            stack, out = [n], []
            while stack:
                out.append(self._leaf(stack))
            self._texts[n] = "".join(out)
        return self._texts[n]


Matrix = list[list[tuple[int, int] | None]]        # [from][to]: cost and rope of the audit


def product(a: Matrix, b: Matrix, ropes: Ropes) -> Matrix:
    """Min-plus product; of equal costs the least audit. (Of the audits of one run of rows between two states at one cost none starts
    another: the rest would be inserts, which cost. So the order of two parts is that of the whole.)"""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            best = None
            for k in range(4):
                x, y = a[i][k], b[k][j]
                if x is None or y is None:
                    continue
                cost, pair = x[0] + y[0], (x[1], y[1])
                if best is None or cost < best[0] or cost == best[0] and ropes.less(pair, best[1]):
                    best = cost, pair
            out[i][j] = best and (best[0], ropes.cat(*best[1]))
    return out


def inserts(ropes: Ropes) -> Matrix:
    """No insert, or the one or two that lead from a state to another."""
    one, two = ropes.of("I"), ropes.of("II")
    out: Matrix = [[(0, 0) if i == j else None for j in range(4)] for i in range(4)]
    for i in (START, AFTER_S, AFTER_A):
        out[i][AFTER_U] = (INSERT, one)
    out[AFTER_U][AFTER_A] = (INSERT, one)
    for i in (START, AFTER_S):
        out[i][AFTER_A] = (2 * INSERT, two)
    return out


def terminals(ropes: Ropes) -> dict[str, Matrix]:
    """Inserts in front of a row, then the row's edit."""
    before, keep, change, delete = inserts(ropes), ropes.of("K"), ropes.of("R"), ropes.of("D")
    out = {}
    for symbol in sorted(set(TERMINAL.values())):
        edit: Matrix = [[(DELETE, delete) if i == j else None for j in range(4)] for i in range(4)]
        if symbol != "X":
            initial, fault = divmod(SYMBOLS.index(symbol), 4)
            extra = CUT_OFF if FAULTS[fault] == "truncated" else 0
            for role, cost, rope in [(r, REROLE, change) for r in ROLES] + [(INITIALS[initial], 0, keep)]:
                for i, j in NEXT.get(role, {}).items():
                    edit[i][j] = (cost + extra, rope)
        out[symbol] = product(before, edit, ropes)
    return out


def compress(text: str, rules: list[str]) -> str:
    """Symbols of turns (one string a line) to terminals of the program, then rule by rule."""
    text = text.translate(TERMINAL)
    for i, pair in enumerate(rules):
        text = text.replace(pair, chr(FIRST_RULE + i))
    return text


def pair_counts(chunks: DataFrame, rules: list[str], most: int, least: int = LEAST_PAIRS) -> list[str]:
    """The most frequent pairs of adjacent symbols in all chunks, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            code = compress("\n".join(batch.column(0).to_pylist()), rules)
            a = np.frombuffer(code.encode("utf-32-le"), np.uint32).astype(np.int64)
            inside = (a[:-1] != 10) & (a[1:] != 10)
            for pair, n in zip(*(x.tolist() for x in np.unique((a[:-1] << 32 | a[1:])[inside], return_counts=True))):
                counts[pair] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])

    found = (chunks.select("symbols").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= least).orderBy(F.desc("n"), "pair").limit(most))
    return [chr(p >> 32) + chr(p & 0xFFFFFFFF) for p in collected(found)["pair"]]


def learn_rules(chunks: DataFrame, most_rules: int = MOST_RULES, rounds: int = ROUNDS) -> list[str]:
    """Re-Pair in rounds: pairs of one round share no symbol between left and right sides, so their occurrences cannot overlap."""
    rules: list[str] = []
    for _ in range(rounds):
        room = most_rules - len(rules)
        left: set[str] = set()
        right: set[str] = set()
        for a, b in pair_counts(chunks, rules, room) if room > 0 else ():
            twin = a == b
            if a in right or b in left or twin and a in left:
                continue
            left.add(a), right.add(b)
            rules.append(a + b)
        if not left:
            break
    return rules


class Program:
    """The transfer matrices of all symbols, and what follows from them for one conversation at a time."""

    def __init__(self, rules: list[str]):
        self.ropes = ropes = Ropes()
        self.matrix = terminals(ropes)
        for i, (a, b) in enumerate(rules):
            self.matrix[chr(FIRST_RULE + i)] = product(self.matrix[a], self.matrix[b], ropes)
        self.last = inserts(ropes)
        self._steps: dict[str, list] = {}
        self._known: dict[str, tuple[int, str]] = {}

    def steps(self, symbol: str) -> list:
        """[to] -> (from, cost, audit) of a symbol ("" for the end), the audits spelled out once per worker."""
        if symbol not in self._steps:
            m = self.matrix[symbol] if symbol else self.last
            self._steps[symbol] = [[(i, m[i][j][0], self.ropes.text(m[i][j][1])) for i in range(4) if m[i][j]] for j in range(4)]
        return self._steps[symbol]

    def advance(self, paths: list, symbol: str) -> list:
        """One symbol further; a path is (cost, chunks before, audit in this chunk)."""
        out = []
        for froms in self.steps(symbol):
            best = None
            for i, cost, audit in froms:
                if paths[i] is not None:
                    total = paths[i][0] + cost
                    if best is None or total <= best[0]:
                        path = (total, paths[i][1], paths[i][2] + audit)
                        if best is None or total < best[0] or _less(path, best):
                            best = path
            out.append(best)
        return out

    def audit(self, codes: list[str]) -> tuple[int, str]:
        """Cost and audit of a conversation, given the compressed strings of its chunks."""
        whole = codes[0] if len(codes) == 1 else None
        if whole in self._known:
            return self._known[whole]
        paths: list = [(0, None, ""), None, None, None]
        for n, code in enumerate(codes):
            if n:
                paths = [p and (p[0], (p[1], p[2]), "") for p in paths]
            for symbol in code:
                paths = self.advance(paths, symbol)
        paths = self.advance(paths, "")
        best = None
        for end in ENDS:
            p = paths[end]
            if p is not None and (best is None or p[0] < best[0] or p[0] == best[0] and _less(p, best)):
                best = p
        found = best[0], _spelled(best, None)
        if whole is not None and len(whole) <= 64:
            if len(self._known) >= 20_000:
                self._known.clear()
            self._known[whole] = found
        return found


def _spelled(path: tuple, until) -> str:
    parts, at = [path[2]], path[1]
    while at is not until:
        parts.append(at[1])
        at = at[0]
    return "".join(reversed(parts))


def _less(p: tuple, q: tuple) -> bool:
    """Whether the audit of path ``p`` is less; chunks that both share are not looked at."""
    if p[1] is q[1]:
        return p[2] < q[2]
    a, b = p[1], q[1]
    while a is not b:       # both have the same number of chunks
        a, b = a[0], b[0]
    return _spelled(p, a) < _spelled(q, b)


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    return turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("d"),
                        role.alias("role"), text.alias("text"))


def marks(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Narrow rows of the turns (of ``_turns``): first fault but for duplicates, the role's initial; and one row without a turn for each conversation."""
    ends = F.rtrim(F.col("text"), F.lit(BLANK))
    initial = F.substring("role", 1, 1)
    own = turns.select(
        "conv_id", "turn", "d", F.lit(True).alias("real"),
        F.when(initial.isin(*"sua"), initial).otherwise("o").alias("initial"),
        F.when(ends == "", 1).when(F.substring(ends, -1, 1).isin(".", "!", "?"), 0).otherwise(3).alias("fault"))
    ids = turns.select("conv_id")
    if conversations is not None:
        ids = ids.unionByName(conversations.select(F.col("conv_id").cast("long").alias("conv_id")))
    extra = ids.distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("d"),
                                  F.lit(False).alias("real"), F.lit("").alias("initial"), F.lit(0).alias("fault"))
    return own.unionByName(extra).withColumn("row", F.monotonically_increasing_id())


def chunks_of(marked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, part, chunk (their order within a conversation), symbols, first_turn, last_turn, n_turns (distinct) of the stored marks."""
    real = marked.where("real and fault <> 1")
    firsts = (real.groupBy(F.col("conv_id").alias("c"), F.col("d").alias("first_d")).agg(
        F.count("*").alias("n"), F.min(F.struct("turn", "row")).alias("first")).where("n > 1").drop("n"))
    repeated = (F.col("fault") != 1) & F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    code = 4 * (F.instr(F.lit(INITIALS), F.col("initial")) - 1) + F.when(repeated, 2).otherwise(F.col("fault"))
    rows = (marked.join(firsts, marked["conv_id"].eqNullSafe(firsts["c"]) & (marked["d"] == firsts["first_d"]), "left")
            .withColumn("symbol", F.when(F.col("real"), F.substring(F.lit(SYMBOLS), code + 1, F.lit(1))).otherwise("")))
    order = ["conv_id", "real", "turn", "d", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now = TaskContext.get().partitionId(), 0, None   # now: conv_id, symbols, first, last and distinct turns

        def rows_of(done):
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in done], pa.int64()), pa.array([part] * len(done), pa.int32()),
                 pa.array(range(number - len(done), number), pa.int64()), pa.array(["".join(x[1]) for x in done], pa.string()),
                 *(pa.array([x[i] for x in done], pa.int64()) for i in (2, 3, 4))],
                names=["conv_id", "part", "chunk", "symbols", "first_turn", "last_turn", "n_turns"])

        for batch in batches:
            done = []
            for conv, turn, symbol in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv or len(now[1]) >= chunk:
                    if now is not None:
                        done.append(now)
                        number += 1
                    now = [conv, [], None, None, 0]
                if symbol:
                    now[1].append(symbol)
                if turn is not None and turn != now[3]:
                    now[2] = turn if now[2] is None else now[2]
                    now[3] = turn
                    now[4] += 1
            if done:
                yield rows_of(done)
        if now is not None:
            number += 1
            yield rows_of([now])

    return (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "symbol")
            .mapInArrow(run, "conv_id long, part int, chunk long, symbols string, first_turn long, last_turn long, n_turns long"))


class _Tally:
    """The counts of one conversation, chunk by chunk."""

    def __init__(self):
        self.codes: list[str] = []
        self.faults: Counter[str] = Counter()
        self.illegal = self.distinct = 0
        self.last_initial = ""
        self.least = self.most = None

    def add(self, code: str, symbols: str, first: int | None, last: int | None, n: int) -> None:
        self.codes.append(code)
        self.faults.update(symbols)
        initials = self.last_initial + "".join(INITIALS[SYMBOLS.index(c) // 4] for c in symbols)
        self.illegal += sum(initials[i:i + 2] not in LEGAL for i in range(len(initials) - 1))
        self.last_initial = initials[-1:]
        if first is not None:
            self.distinct += n - (first == self.most)
            self.least = first if self.least is None else self.least
            self.most = last

    def report(self, program: Program) -> tuple:
        cost, audit = program.audit(self.codes)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        found = [sum(n for c, n in self.faults.items() if SYMBOLS.index(c) % 4 == k) for k in (1, 2, 3)]
        return (gaps, *found, self.illegal, cost), audit


def repair(turns: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", most_rules: int = MOST_RULES, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """For each conversation one row with ``at`` 0 (gaps, blank, duplicate, truncated, illegal, cost, audit), then its repaired rows
    (``at`` 1, 2, ...: edit, role, text), following each other in one partition. ``conversations``: further ids (conv_id) that get a report."""
    own = _turns(turns, conv_col, turn_col, role_col, text_col)
    cut = stored(chunks_of(stored(marks(own, conversations), "structure-marks"), chunk), "structure-chunks")
    rules = learn_rules(cut, most_rules, rounds)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = compress("\n".join(batch.column("symbols").to_pylist()), rules).split("\n") if len(batch) else []
            yield batch.append_column("code", pa.array(codes, pa.string()))

    short = cut.mapInArrow(coded, "conv_id long, part int, chunk long, symbols string, first_turn long, last_turn long, n_turns long, code string")
    both = short.withColumn("real", F.lit(False)).unionByName(own.withColumn("real", F.lit(True)), allowMissingColumns=True)
    names = [f.split()[0] for f in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * len(REPORT), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program(rules)
        out: list[list] = [[] for _ in names]
        now, tally, audit, used, at, before = object(), None, None, 0, 0, ""

        def put(*values):
            for column, v in zip(out, values):
                column.append(v)

        def open_report():
            nonlocal audit, used, at, before
            numbers, audit = tally.report(program)
            used, at, before = 0, 0, ""
            put(now, 0, None, None, None, *numbers, audit)

        def insert_all():
            nonlocal used, at, before
            while audit[used:used + 1] == "I":
                before = "a" if before == "u" else "u"
                used, at = used + 1, at + 1
                put(now, at, "I", ROLES[before], "", *[None] * 7)

        def close():
            if tally is not None:
                if audit is None:
                    open_report()
                insert_all()

        for whole in batches:
            for batch in batch_slices(whole, 2):
                for conv, role, text, real, code, symbols, first, last, n in zip(*(c.to_pylist() for c in batch.columns)):
                    if conv != now:
                        close()
                        now, tally, audit = conv, _Tally(), None
                    if not real:
                        tally.add(code, symbols, first, last, n)
                        continue
                    if audit is None:
                        open_report()
                    insert_all()
                    edit, used = audit[used], used + 1
                    if edit == "D":
                        continue
                    before = role[:1] if edit == "K" else "a" if before == "u" else "u"
                    at += 1
                    put(now, at, edit, role if edit == "K" else ROLES[before], text, *[None] * 7)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                    out = [[] for _ in names]
        close()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return (both.repartition("conv_id").sortWithinPartitions("conv_id", "real", "part", "chunk", "turn", "d")
            .select("conv_id", "role", "text", "real", "code", "symbols", "first_turn", "last_turn", "n_turns").mapInArrow(run, OUT))


def conversation_reports(repaired: DataFrame) -> DataFrame:
    """Per conversation, from the output of ``repair`` (whose row order it keeps): the report and the SHA-256 of the repaired
    rows ``role:text``, joined by line breaks."""
    names = ["conv_id", *REPORT, "audit", "repaired_sha256"]
    kinds = [pa.int64()] * (1 + len(REPORT)) + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest = None, None
        for whole in batches:
            rows = []
            for batch in batch_slices(whole, 3):
                for conv, at, role, text, *report in zip(*(c.to_pylist() for c in batch.columns)):
                    if at == 0:
                        if head is not None:
                            rows.append((*head, digest.hexdigest()))
                        head, digest = (conv, *report), hashlib.sha256()
                        continue
                    digest.update(f"{chr(10) if at > 1 else ''}{role}:{text}".encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if head is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*head, digest.hexdigest()), kinds)], names=names)

    return (repaired.select("conv_id", "at", "role", "text", *REPORT, "audit")
            .mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired_sha256 string"))


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with faults planted by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats
    it, 4 makes it a user's. Nulls are one space."""
    def spelled(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn"))) % 20
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spelled("text"), "[.!?]", "")).otherwise(spelled("text"))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spelled("role")).alias("role"), text.alias("text"),
                        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")
