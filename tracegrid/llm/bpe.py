"""Byte-level BPE: ranked merges folded over the bytes of distinct words, in Python workers and as Spark higher-order functions."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.text import clean, map_rows
from tracegrid.session import ship

CACHE, BUCKETS, LONG = 300_000, 16_384, 200


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: always the pair of lowest rank, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > LONG:
        return merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list, for pieces where rescans would cost their square."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            stop = end[after[i]]
            rank = ranks.get(piece[i:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, i, stop))

    for i in range(n):
        offer(i)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j] = 0
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes whole texts. A space before a visible character always begins a pre-token, so the parts of a text between such
    spaces are encoded apart, once for each distinct part while the cache (of at most CACHE parts) holds it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.cache, self.old, self.words = {}, {}, {}
        size = max(ranks.values(), default=-1) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def part(self, part: str) -> bytes:
        found = self.old.get(part)
        if found is None:
            found = b"".join([self.word(piece) for piece in self.find(part)])
        if len(part) <= 64:
            if len(self.cache) >= CACHE:  # two generations: what is in use moves on, the rest goes
                self.old, self.cache = self.cache, {}
            self.cache[part] = found
        return found

    def word(self, piece: str) -> bytes:
        found = self.words.get(piece)
        if found is None:
            found = array("I", merge(piece.encode("utf-8", "surrogatepass"), self.ranks)).tobytes()
            if len(piece) <= 64:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts: list[str] = []
        chunks = text.split(" ")
        if chunks[0]:
            parts.append(chunks[0])
        for chunk in chunks[1:]:
            if chunk and not chunk[0].isspace():
                parts.append(" " + chunk)
            elif parts:
                parts[-1] += " " + chunk
            else:
                parts.append(" " + chunk)
        part = self.part
        return b"".join([self.cache.get(p) or part(p) for p in parts])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict = {}


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids the ids themselves, per row; decoded_sha256 is that of the bytes which the ids give.

    Null text counts as empty (no tokens); null doc_ids and repeated rows stay as they are; other columns are ignored."""
    ship(docs.sparkSession)
    ranks = read_ranks(rank_file)  # some MB, with the rank file's size as its bound; goes with the task
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        key = (rank_file, pattern)
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(shared.value, pattern))
        for r in source:
            ids = encoder.encode(r["text"])
            back = encoder.decode(ids)
            out = (r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest())
            yield (*out, np.frombuffer(ids, "<u4").tolist()) if with_ids else out

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(clean(docs), schema + (", ids array<bigint>" if with_ids else ""), rows)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: an array of small maps by crc32 of the piece's hex, as a map of Spark's is searched from end to end."""
    parts: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        parts[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), "array<map<string,int>>")


def bind(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def encode_words_native(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """word (binary) to word, ids: the fold of ranked merges in Spark's higher-order functions. A step merges every occurrence of the
    leftmost pair of lowest rank, so a word takes as many steps that change it as it has different merges."""
    table = rank_literal(ranks)

    def rank(key: Column) -> Column:
        return F.element_at(F.element_at(table, F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int") + 1), key)

    def step(state: Column, _: Column) -> Column:
        def merged(p: Column) -> Column:
            n = F.size(p)
            pairs = F.zip_with(F.slice(p, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), lambda a, b: rank(F.concat(a, b)))

            def best(r: Column) -> Column:
                low = F.array_min(r)
                i = F.array_position(r, low).cast("int")
                a, b = F.element_at(p, i), F.element_at(p, i + 1)
                inner = F.replace(F.concat(F.lit("<"), F.array_join(p, "><"), F.lit(">")), F.concat(F.lit("<"), a, F.lit("><"), b, F.lit(">")), F.concat(F.lit("<"), a, b, F.lit(">")))
                return F.when(low.isNull(), F.array_join(p, "><")).otherwise(F.regexp_replace(inner, "^<|>$", ""))

            return F.when(n < 2, F.array_join(p, "><")).otherwise(bind(pairs, best))

        return bind(F.split(state, "><"), merged)

    hexed = F.hex("word")
    start = F.array_join(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1)), "><")
    end = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(hexed) / 2 - 1).cast("int")), start, step)
    whole = rank(hexed)
    ids = F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(F.split(end, "><"), rank))
    return words.select("word", ids.alias("ids"))


def decode_native(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Binary pieces of the ids, concatenated."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, (i + 1).cast("int"))), ""))
