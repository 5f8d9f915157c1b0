"""Line deduplication over runs of lines: the least runs of every place meet by hash, and a longer repeated run is the union of its least runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tracegrid.llm.text import clean, map_rows, row_key, unused
from tracegrid.session import discard, materialise, ship, tidy


def prefixes(run: list[bytes]) -> Iterator[bytes]:
    """The bytes of each prefix of two lines or more; equal lines in a row are counted, so a long blank stretch stays short."""
    done, last, n = b"", run[0], 1
    for line in run[1:]:
        if line == last:
            n += 1
        else:
            done, last, n = done + b"%d %s\n" % (n, last), line, 1
        yield done + b"%d %s" % (n, last)


def units(lines: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(first line, line after the last, bytes) of the least runs: two lines that are not blank, or a blank line with all lines up to
    the nearest one that is not, before it and after it. Every run of two lines or more, one of them not blank, is a union of these."""
    full = [i for i, line in enumerate(lines) if line.strip()]
    for i, j in zip([-1, *full], [*full, len(lines)], strict=True):
        if i >= 0:
            run = lines[i : j + 1] if j == i + 1 else lines[i:j]
            for n, body in enumerate(prefixes(run), 2):
                yield i, i + n, b">" + body
        if j < len(lines) and j > i + 1:
            for n, body in enumerate(prefixes(lines[i + 1 : j + 1][::-1]), 2):
                yield j + 1 - n, j + 1, b"<" + body


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def multi_line(text: str) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of the units."""
    for k, (_, _, body) in enumerate(units(split(text))):
        yield k, body


def without(text: str, numbers: set[int]) -> tuple[str, int]:
    lines = text.split("\n")
    gone = {i for k, (a, b, _) in enumerate(units(split(text))) if k in numbers for i in range(a, b)}
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), len(gone)


def with_repeats(docs: DataFrame, drop: str) -> DataFrame:
    """docs with a column named drop: the numbers of the units that occur before, or null. Written once, as the bytes behind the hashes are
    compared before anything is removed. Of equal units that of the smallest (doc_id, hash of the text, number) stays, whole: a
    unit of the same text that overlaps it is no repeat."""
    id_type = dict(docs.dtypes)["doc_id"]
    base = clean(docs.filter("doc_id IS NOT NULL AND instr(text, '\\n') > 0")).withColumn("key", row_key())

    def found(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            for k, (a, b, body) in enumerate(units(split(r["text"]))):
                yield r["doc_id"], r["key"], k, a, b, xxhash.xxh3_128_digest(body)

    seen = materialise(map_rows(base, f"doc_id {id_type}, key long, k int, a int, b int, h binary", found, per_batch=20_000), "units")
    first = seen.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "k", "b")).alias("first")).filter("n > 1")
    later = (F.struct("doc_id", "key", "k", "b") > F.col("first")) & ~((F.col("doc_id") == F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("a") < F.col("first.b")))
    i, key, every = unused(docs, "_id", "_key", "_all")
    spots = seen.join(first, "h").groupBy(F.col("doc_id").alias(i), F.col("key").alias(key)).agg(F.collect_set("k").alias(every), F.collect_set(F.when(later, F.col("k"))).alias(drop))
    joined = docs.join(spots, (docs["doc_id"] == spots[i]) & (row_key() == spots[key]), "left").drop(i, key)
    joined = materialise(joined, "lines")
    discard(seen)

    def bodies(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            wanted = set(r["every"])
            for k, body in multi_line(r["text"]):
                if k in wanted:
                    yield xxhash.xxh3_128_digest(body), body

    held = joined.filter(F.col(every).isNotNull()).select("text", F.col(every).alias("every"))
    unequal = map_rows(held, "h binary, body binary", bodies).groupBy("h").agg((F.min("body") != F.max("body")).alias("unequal")).filter("unequal")
    with tidy(docs.sparkSession):
        if not unequal.isEmpty():
            raise RuntimeError("different runs of lines share a 128-bit hash")
    return joined.drop(every)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated runs of lines removed from text, and n_removed_lines; every row stays.

    A run of two lines or more, one of them not blank, that occurs anywhere else (or again in its document) stays only at its first
    occurrence by doc_id. Rows without text, without doc_id or of one line are left alone; rows that repeat a doc_id and its text are
    treated alike. Columns other than doc_id and text pass through, n_chars (if there) follows the text. Runs meet by 128-bit hashes and are compared
    byte by byte; should two ever differ under one hash, the run stops and nothing is removed. A column of the name n_removed_lines
    is replaced."""
    ship(docs.sparkSession)
    docs = docs.drop("n_removed_lines")
    drop = unused(docs, "_drop")[0]
    out = StructType([*docs.schema.fields, StructField("n_removed_lines", IntegerType())])

    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column("text").to_pylist(), batch.column(drop).to_pylist()
            made = [without(t, set(d)) if d else (t, 0) for t, d in zip(texts, drops, strict=True)]
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array([t for t, _ in made], batch.column("text").type)
            if "n_chars" in columns:
                counts = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(t) if d else c for (t, _), d, c in zip(made, drops, counts, strict=True)], columns["n_chars"].type)
            columns["n_removed_lines"] = pa.array([g for _, g in made], pa.int32())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return with_repeats(docs, drop).mapInArrow(cut, out)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines_left, n_removed_lines, kept_sha256 per document, by dedup_lines."""
    out = dedup_lines(clean(docs))
    return out.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines_left"), F.col("n_removed_lines").cast("long").alias("n_removed_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
