"""Dictionary matching as joins: which entries of a table occur in which texts, for dictionaries of any size.

The rule is that of ``text.extract_skills``: entries of at most two characters must stand as whole words, longer ones match as
lower-case substrings. Texts are cut at blanks, and only the distinct words of all texts are compared: an entry without blanks
occurs in a text exactly if it occurs in one of its words; an entry with blanks is looked for by its longest part first
and then in the texts that hold this part. Words and entries meet on the rarest trigram of each entry (shorter
entries: the entry itself), as counted over the distinct words, and are verified by a substring test. Neither the dictionary nor
the words pass through the driver; the word list that goes back to the texts is broadcast only if counted small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.text import NON_WORD_CLASS, WORD_CLASS
from matchspark.session import checkpointed

BLANK = r"[ \t\n\r]"
GRAM = 3
PIECE = 1_000              # characters of a word that are spelled out at a time
BROADCAST_HITS = 100_000   # (word, entry) pairs are broadcast up to this many, else shuffled


def words_of(text: Column) -> Column:
    """Lower-case words of a text, repeats included, and the empty word, which every text has."""
    return F.split(F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), BLANK)


def grams(word: Column, sizes: list[int]) -> Column:
    """Runs of so many characters (repeats included)."""
    def all_runs(chars: Column) -> Column:
        def runs(n: int) -> Column:
            return F.transform(chars, lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, n)]))  # null at the end

        return F.concat(*[runs(n) for n in sizes])

    # the characters are bound once per word, as a lambda variable
    return F.element_at(F.transform(F.array(F.split(word, "")), all_runs), 1)


def entries_of(dictionary: DataFrame, skill: str = "skill", order: str = "pos") -> DataFrame:
    """One row per entry: skill, pos (least), low, part (its longest part without blanks), single (it has no
    blanks), whole (pattern it must match, null if any substring will do)."""
    s = F.col(skill)
    rows = dictionary.where(s.isNotNull() & (s != "")).groupBy(s.alias("skill")).agg(F.min(order).alias("pos"))
    rows = rows.withColumn("low", F.lower("skill"))
    parts = F.transform(F.split("low", BLANK), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    part = F.array_max(parts)["p"]  # empty for an entry of blanks only
    first, last = F.col("low").substr(1, 1), F.substring("low", -1, 1)
    pattern = F.concat(F.when(first.rlike(WORD_CLASS), f"(^|{NON_WORD_CLASS})").otherwise(WORD_CLASS),
                       F.lit(r"\Q"), F.col("low"), F.lit(r"\E"),  # lower-cased: the entry cannot end the quotation
                       F.when(last.rlike(WORD_CLASS), f"($|{NON_WORD_CLASS})").otherwise(WORD_CLASS))
    return rows.select("skill", "pos", "low", part.alias("part"), (~F.col("low").rlike(BLANK)).alias("single"),
                       F.when(F.length("skill") <= 2, pattern).alias("whole"))


def _found(text: Column) -> Column:
    return text.contains(F.col("low")) & (F.col("whole").isNull() | F.regexp_like(text, F.coalesce("whole", F.lit(""))))


def dictionary_hits(words: DataFrame, entries: DataFrame) -> DataFrame:
    """word, skill, pos, low, whole, single: the distinct ``word`` rows that hold an entry (``single``) or its part."""
    size = F.least(F.lit(GRAM), F.length("part"))
    sizes = [r["n"] for r in entries.where("part <> ''").select(size.alias("n")).distinct().collect()]  # GRAM numbers at most
    of_blanks = entries.where("part = ''").select(F.lit("").alias("word"), "skill", "pos", "low", "whole", "single")
    if not sizes:
        return of_blanks
    entry_grams = entries.select("*", F.explode(F.filter(grams(F.col("part"), sizes), lambda g: F.length(g) == size)).alias("gram"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - GRAM + 1), F.lit(PIECE - GRAM + 1))
    pieces = words.select("word", F.explode(F.transform(starts, lambda i: F.substr("word", i, F.lit(PIECE)))).alias("piece"))
    word_grams = checkpointed(pieces.select("word", F.explode(grams(F.col("piece"), sizes)).alias("gram"))
                              .join(entry_grams.select("gram").distinct(), "gram", "left_semi"))
    rare = (entry_grams.join(word_grams.groupBy("gram").count(), "gram", "left")
            .groupBy("skill").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "gram")).alias("least"))
            .select("skill", F.col("least.gram").alias("gram")))
    met = word_grams.join(rare.join(entries, "skill"), "gram").where(F.col("word").contains(F.col("part")))
    return (met.where(~F.col("single") | _found(F.col("word")))
            .select("word", "skill", "pos", "low", "whole", "single").dropDuplicates(["word", "skill"]).unionByName(of_blanks))


def dictionary_matches(rows: DataFrame, key: str, text: Column, dictionary: DataFrame, skill: str = "skill",
                       order: str = "pos") -> DataFrame:
    """``key``, ``skill``, ``pos``: one row per entry of ``dictionary`` found in a text. Rows that share a key count as one,
    rows without a key are left out; a null text has no words; duplicate entries count once, with their least ``order``."""
    texts = rows.select(F.col(key).alias("__key"), text.alias("__text")).where("__key is not null")
    spread = texts.select("__key", F.explode(words_of(F.col("__text"))).alias("word"))
    words = spread.select("word").distinct()
    hits = checkpointed(dictionary_hits(words, checkpointed(entries_of(dictionary, skill, order))))
    kinds = {r["single"]: r["count"] for r in hits.groupBy("single").count().collect()}  # two rows at most

    def side(single: bool) -> DataFrame:
        some = hits.where(F.col("single") == single)
        return F.broadcast(some) if kinds.get(single, 0) <= BROADCAST_HITS else some

    found = spread.join(side(True), "word").groupBy("__key", "skill").agg(F.min("pos").alias("pos"))
    if kinds.get(False):
        maybe = spread.join(side(False), "word").groupBy("__key", "skill").agg(
            *[F.first(c).alias(c) for c in ("pos", "low", "whole")])
        there = maybe.join(texts, "__key").where(_found(F.lower(F.coalesce("__text", F.lit("")))))
        found = found.unionByName(there.groupBy("__key", "skill").agg(F.first("pos").alias("pos")))
    return found.withColumnRenamed("__key", key)
