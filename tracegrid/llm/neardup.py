"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.components import connected_components
from tracegrid.llm.text import clean, map_rows, mix64, shingle_hashes
from tracegrid.session import discard, materialise, ship, tidy

BINS, BANDS, TRIES = 128, 32, 512
BITS, WIDE, WIDE_FROM = 512, 4096, 384
_TRY = (mix64(np.arange(BINS * TRIES, dtype=np.uint64) + np.uint64(0x5EED)) >> np.uint64(57)).astype(np.int64).reshape(BINS, TRIES)


def one_permutation(hashes: np.ndarray) -> np.ndarray:
    """BINS minima of one hash function: the top bits of a (sorted) hash choose its bin. Empty bins are filled from a bin that a
    2-universal sequence of tries of their own finds (optimal densification), the same sequence for every document."""
    starts = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << np.uint64(57))
    full = np.diff(np.append(starts, len(hashes))) > 0
    source = np.arange(BINS)
    if not full.all():
        empty = np.flatnonzero(~full)
        hits = full[_TRY[empty]]
        source[empty] = np.where(hits.any(1), _TRY[empty, hits.argmax(1)], np.flatnonzero(full)[0])
    return hashes[starts[source]]


def bands(signature: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(n_bands, -1)
    key = np.arange(n_bands, dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def parity_bits(hashes: np.ndarray, size: int) -> list[int]:
    """A bit for each of `size` parts of the hash space, as 64-bit words: whether an odd number of the set's hashes falls there. The
    bits in which two sets differ are never more than the hashes that only one of them has."""
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def set_columns(hashes: np.ndarray) -> tuple[list[int], list[int] | None]:
    """The bits of a set, and finer ones of a set that may differ from a like one in more elements than the first can tell."""
    return parity_bits(hashes, BITS), parity_bits(hashes, WIDE) if len(hashes) > WIDE_FROM else None


def sketches(docs: DataFrame, width: int, sign: Callable[[np.ndarray], np.ndarray] = one_permutation) -> DataFrame:
    """doc_id, n (set size), set_key (128 bits of the whole set; null for an empty one), bands, bits, wide."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            h = shingle_hashes(r["text"], width)
            if len(h):
                yield r["doc_id"], len(h), xxhash.xxh3_128_digest(h.tobytes()), bands(sign(h)).tolist(), *set_columns(h)
            else:
                yield r["doc_id"], 0, None, None, None, None

    return map_rows(clean(docs), f"doc_id {dict(docs.dtypes)['doc_id']}, n int, set_key binary, bands array<bigint>, bits array<bigint>, wide array<bigint>", rows)


def set_nodes(sketch: DataFrame) -> DataFrame:
    """id (the smallest doc_id), set_key, n, bands, bits, wide of each distinct set that is not empty: exact copies cost a row once."""
    known = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    return known.groupBy("set_key").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "bands", "bits", "wide")))


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, s: the whole shingle sets of the documents that wanted (id) lists."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            yield r["doc_id"], shingle_hashes(r["text"], width).view(np.int64).tolist()

    asked = clean(docs).join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return map_rows(asked, f"id {dict(docs.dtypes)['doc_id']}, s array<bigint>", rows)


def similar(pairs: DataFrame, sets: DataFrame, threshold_percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose whole sets have 100 * intersection >= threshold * union."""
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    return both.filter(F.col("i") * 100 >= (F.col("t") - F.col("i")) * threshold_percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def side(nodes: DataFrame, name: str, *more: str) -> DataFrame:
    """The columns of a pair's side that may_link reads: n, the words of bits, wide, each with the name as prefix."""
    words = [F.col("bits")[k].alias(f"{name}_{k}") for k in range(BITS // 64)]
    return nodes.select(F.col("id").alias(name), F.col("n").alias(f"{name}_n"), *words, F.col("wide").alias(f"{name}_wide"), *more)


def may_link(a: str, b: str, threshold_percent: int) -> str:
    """What holds for every pair at the threshold: the sizes are near enough, and the sets differ in no more elements than their
    sizes allow, of which the differing bits are a lower bound. It drops no link."""
    most = f"{100 - threshold_percent}L * ({a}_n + {b}_n)"
    differing = " + ".join(f"bit_count({a}_{k} ^ {b}_{k})" for k in range(BITS // 64))
    finer = f"aggregate(zip_with({a}_wide, {b}_wide, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    return (
        f"100L * least({a}_n, {b}_n) >= {threshold_percent}L * greatest({a}_n, {b}_n) AND {100 + threshold_percent}L * ({differing}) <= {most}"
        f" AND ({a}_wide IS NULL OR {b}_wide IS NULL OR {100 + threshold_percent}L * {finer} <= {most})"
    )


def find_links(nodes: DataFrame, docs: DataFrame, width: int, threshold_percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) between nodes, confirmed on whole sets, that connect all links' ends; and the components (id, component).

    A bucket of equal bands proposes a star from its smallest node to the others. Links that a star leaves out matter only between
    components: members of a bucket outside its commonest component then meet the bucket's other components. Pairs leave either join
    only if may_link holds, so what is written grows with pairs at the threshold or just below it, not with a bucket's square."""
    members = nodes.select("id", F.explode("bands").alias("bucket"))
    centre = members.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("size")).filter("size > 1").drop("size")
    shared = materialise(members.join(centre, "bucket"), "shared")
    sets = materialise(shingle_sets(docs, shared.select("id").distinct(), width), "sets")
    stars = shared.select(F.col("centre").alias("x"), F.col("id").alias("y")).filter("x <> y").distinct().join(side(nodes, "x"), "x").join(side(nodes, "y"), "y")
    stars = materialise(stars.filter(may_link("x", "y", threshold_percent)).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "stars")
    links = materialise(similar(stars, sets, threshold_percent), "links")
    groups = connected_components(links)
    # buckets whose members are still apart
    placed = shared.select("bucket", "id").join(groups.withColumnRenamed("component", "g"), "id", "left").withColumn("g", F.coalesce("g", "id"))
    shares = placed.groupBy("bucket", "g").agg(F.count("*").alias("k"))
    mixed = shares.groupBy("bucket").agg(F.max_by("g", F.struct("k", "g")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    open_ = materialise(placed.join(mixed, "bucket").join(nodes.select("id", "n", "bits", "wide"), "id"), "open")
    few = side(open_.filter("g <> main"), "x", "bucket", F.col("g").alias("gx"))
    rest = side(open_, "y", "bucket", F.col("g").alias("gy"), "main")
    met = F.expr(f"f.bucket = r.bucket AND gx <> gy AND (gy = main OR x < y) AND {may_link('x', 'y', threshold_percent)}")
    cross = few.alias("f").join(rest.alias("r"), met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    cross = materialise(cross.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "cross")
    more = materialise(similar(cross, sets, threshold_percent), "links")
    discard(shared, sets, stars, open_, cross)
    with tidy(nodes.sparkSession):
        settled = more.isEmpty()
    if not settled:
        groups = connected_components(groups.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more))
    return links.unionByName(more), groups


def near_duplicates(docs: DataFrame, width: int = 5, threshold_percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of docs.

    Documents of equal shingle sets are one node, so exact copies cost one row each. Nodes meet in buckets of equal bands, by stars
    and between what the stars leave apart (find_links); links are confirmed on whole sets. With 32 bands of 4 a pair at 0.8 shares a
    bucket but for one in 20 million; no pair that shares one is lost.

    Null or empty texts link with nothing and are kept; rows with a null doc_id too, with a null component. Rows of one doc_id
    are one document, linked by any of its texts. Other columns are ignored; an empty table gives an empty result."""
    ship(docs.sparkSession)
    sketch = materialise(sketches(docs, width), "sketch")
    nodes = materialise(set_nodes(sketch), "nodes")
    _, groups = find_links(nodes, docs, width, threshold_percent)
    of_set = nodes.select("set_key", "id").join(groups, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    of_doc = sketch.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "set_key").join(of_set, "set_key").groupBy("doc_id").agg(F.min("component_id").alias("g"))
    return (
        sketch.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(of_doc, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("g", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, width: int = 5, threshold_percent: int = 80) -> DataFrame:
    """The documents without the near copies: of each component the one with the smallest doc_id stays, whole, and all that link with nothing."""
    gone = near_duplicates(docs, width, threshold_percent).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
