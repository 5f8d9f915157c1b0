"""Word shingles and Arrow helpers that several operators share. Only ASCII A-Z is lower-cased; words are split at space and \\t..\\r."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WORD_CACHE = 300_000


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; a cache that is emptied when full, so its size has a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHashes()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than width make one shingle, none make none."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    span = min(width, len(tokens))
    acc = np.full(len(h) - span + 1, span, np.uint64)
    for j in range(span):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - span + 1 + j])
    return np.unique(acc)


def clean(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text with null text as empty, without columns that an operator does not use."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterator[tuple]], per_batch: int = 2000) -> DataFrame:
    """mapInArrow over Python rows; results leave in bounded batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source() -> Iterator[dict]:
            for batch in batches:
                for part in range(0, batch.num_rows, 256):
                    columns = batch.slice(part, 256).to_pydict()
                    yield from (dict(zip(columns, values, strict=True)) for values in zip(*columns.values(), strict=True))

        held: list[tuple] = []
        weight = 0
        for row in rows(source()):
            held.append(row)
            weight += sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
            if len(held) >= per_batch or weight > 8 << 20:
                yield pack(held, kind)
                held, weight = [], 0
        if held:
            yield pack(held, kind)

    return df.mapInArrow(run, schema)


def pack(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores appended until no column of docs has them (in any case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_key() -> Column:
    """With doc_id, identifies a document even where a doc_id is repeated with another text; equal rows share it."""
    return F.xxhash64("text")
