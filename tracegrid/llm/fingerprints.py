"""Document fingerprints: MinHash by many universal hash permutations over word shingles, in vectorised numpy."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.neardup import find_links, set_nodes, sketches
from tracegrid.llm.text import clean, map_rows, mix64, shingle_hashes
from tracegrid.session import materialise, ship

PERMUTATIONS, BLOCK, MAX_BLOCKS = 128, 4096, 20_000
_A = (mix64(np.arange(PERMUTATIONS, dtype=np.uint64) + np.uint64(11)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix64(np.arange(PERMUTATIONS, dtype=np.uint64) + np.uint64(99_991)) >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum under each permutation h -> a h + b of the 32-bit numbers; of no shingle, all ones. Long sets go in blocks."""
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), BLOCK):
        np.minimum(out, (short[at : at + BLOCK, None] * _A + _B).min(0), out=out)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal slots: an estimate of the Jaccard similarity of the shingle sets."""
    return float((a == b).mean())


def text_signature(text: str | None, width: int) -> np.ndarray:
    return signature(shingle_hashes(text, width))


def fingerprint_pairs(docs: DataFrame, width: int = 5, threshold_percent: int = 80) -> DataFrame:
    """Pairs (u, v) of near-duplicate documents: signature bands are joined in Spark, Jaccard is verified on whole shingle sets.

    The pairs connect all near-duplicates of a group; they do not list every pair of it. Documents of equal shingle sets meet
    through their smallest doc_id (u) and enter the buckets once (set_nodes, find_links). Null doc_ids, null and empty texts are in
    no pair."""
    ship(docs.sparkSession)
    usable = docs.filter("doc_id IS NOT NULL")
    signed = materialise(sketches(usable, width, lambda h: signature(h).astype(np.uint64)), "signed")
    nodes = materialise(set_nodes(signed), "nodes")
    links, _ = find_links(nodes, usable, width, threshold_percent)
    same = signed.join(nodes.select("set_key", "id"), "set_key").filter("id <> doc_id").select(F.col("id").alias("u"), F.col("doc_id").alias("v"))
    return links.unionByName(same).distinct()


def block_edges(ids: DataFrame, parts: int) -> list:
    """Sorted ids that cut doc_id into about `parts` even ranges; one a range comes to the driver. Numbers by quantiles, other types
    by the ranges that a range partitioning finds."""
    if parts < 2:
        return []
    if dict(ids.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        cuts = ids.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("q")).first()["q"]
        return sorted(set(cuts or []))
    ranged = ids.filter("doc_id IS NOT NULL").repartitionByRange(parts, "doc_id")
    return sorted(r["low"] for r in ranged.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("low")).collect())[1:]


def edited_fingerprints(docs: DataFrame, width: int = 5, rows_per_block: int = 2000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of docs.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document in
    descending doc_id, after the last the first; ties go by the hash of the text; null doc_ids come last. Null text counts as
    empty; an empty text has the fingerprint of no shingle. A single document is its own next one.

    Blocks of consecutive ids hold their rows in order; the first row of a block is also sent to the block before it, so every
    row meets its successor in its own block and no task holds more than one block's rows beyond the batch it reads."""
    spark = ship(docs.sparkSession)
    id_type = dict(docs.dtypes)["doc_id"]
    base = clean(docs).withColumn("tie", F.xxhash64("text"))
    n = docs.count()
    parts = max(1, -(-n // max(rows_per_block, n // MAX_BLOCKS)))
    edges = block_edges(docs.select("doc_id"), parts)

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        if ids.dtype == object:
            return pd.Series([-1 if i is None else bisect.bisect_right(edges, i) for i in ids], dtype="int32")
        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(np.array(edges, np.int64), ids.fillna(0).to_numpy(np.int64), side="right")).astype(np.int32))

    placed = base.withColumn("block", block("doc_id"))
    heads = placed.groupBy("block").agg(F.max_by(F.struct("doc_id", "tie"), F.struct("doc_id", F.bitwise_not("tie"))).alias("h")).collect()
    order = sorted((r["block"] for r in heads), reverse=True)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    head = spark.createDataFrame([(r["block"], r["h"]["doc_id"], r["h"]["tie"], before[r["block"]]) for r in heads], f"block int, hid {id_type}, htie long, before int") if heads else None
    if head is None:
        return base.select("doc_id", F.lit(0).cast("long").alias("n_chars"), *(F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next"))
    sent = placed.join(F.broadcast(head), "block", "left")
    first = F.col("doc_id").eqNullSafe(F.col("hid")) & (F.col("tie") == F.col("htie"))
    copies = F.when(first, F.array(F.struct(F.col("block").alias("to"), F.lit(0).alias("look")), F.struct(F.col("before").alias("to"), F.lit(1).alias("look")))).otherwise(F.array(F.struct(F.col("block").alias("to"), F.lit(0).alias("look"))))
    sent = sent.withColumn("copy", F.explode(copies)).select("copy.to", "copy.look", "doc_id", "tie", "text")
    width_of = max(1, min(parts, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = sent.repartition(width_of, "to").sortWithinPartitions("to", "look", F.desc_nulls_last("doc_id"), "tie", "text")

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        held = None
        for r in source:
            if held is not None and held["to"] == r["to"] and not held["look"]:
                r["sig"] = text_signature(r["text"], width)
                yield made(held, r, width)
            elif "sig" not in r:
                r["sig"] = text_signature(r["text"], width) if not r["look"] else None
            held = r

    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_rows(ordered, schema, rows, per_batch=500)


def made(row: dict, after: dict, width: int) -> tuple:
    text, cut = row["text"], len(row["text"]) // 3
    edited = text[: len(text) - cut] + after["text"][:cut] if cut else text
    own, changed = row["sig"], text_signature(edited, width)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return row["doc_id"], len(text), digest, own.tobytes().hex(), changed.tobytes().hex(), likeness(own, changed), likeness(own, after["sig"])
