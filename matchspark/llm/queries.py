"""The registered queries of this subpackage. Each is thin: it calls its operator with production
parameters on whole tables and derives the digest columns."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm import (bpe, chat, exact_dedup, filter_audit, line_dedup, packing, quality_rules, sharding, simhash, structure,
                            token_orc, toxicity, weak_quality)
from matchspark.llm.common import int32_lists, read_table, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@functools.cache
def _numerals(size: int) -> list[str]:
    return [str(i) for i in range(size)]


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = bpe.Decoder(bpe.encoder(path).merges)
        numerals = _numerals(len(dec.spelled))
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for view in int32_lists(batch.column(1)):
                ids = np.frombuffer(view, "<i4").tolist()
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(map(numerals.__getitem__, ids)).encode()).hexdigest())
                text = hashlib.sha256()
                for i in range(0, len(ids), 1 << 14):
                    text.update(dec.feed(ids[i:i + (1 << 14)]).encode())
                text.update(dec.finish().encode())
                text_hex.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    encoded = bpe.bpe_encode(read_table(spark, sf_dir, "documents"), path)
    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query
def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-orc")
    token_orc.write_token_orc(read_table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return token_orc.ids_crc32(token_orc.read_token_orc(spark, folder))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(extra)))


@query
def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), sharding.QUERY_LIMIT)


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality_scores(read_table(spark, sf_dir, "documents"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return structure.conversation_reports(structure.repair(structure.damaged(turns), turns.select("conv_id")))


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
