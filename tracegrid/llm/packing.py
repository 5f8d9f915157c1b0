"""Best-fit packing of token sequences: planned over the histogram of lengths, then pieces take the planned slots by rank."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.llm.text import clean, map_rows
from tracegrid.session import materialise, ship

CACHE = 300_000
#: Punctuation that letters are parted from; not the apostrophe (contractions) nor what begins and ends a special token.
AROUND = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: The characters that byte-level models have for bytes: those that print are themselves, the others follow from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTED)}

#: The steps around a model whose words of letters can go to it straight away.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def plan(counts: dict[int, int], room: int) -> dict[int, list[tuple[int, int, int]]]:
    """Best-fit decreasing over counts of lengths: length to runs (rank from, sequence of that rank, offset), by rising rank.

    Sequences of equal contents are one group, so the work and the plan grow with the lengths and the room left, not with pieces."""
    groups: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]  # by room left: (first sequence, how many)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    made = 0
    for length in sorted(counts, reverse=True):
        todo, rank, runs = counts[length], 0, slots.setdefault(length, [])
        left = length
        while todo:
            while left <= room and not groups[left]:
                left += 1
            if left > room:
                fit = room // length  # new sequences, filled with this length alone
                if whole := todo // fit:
                    for k in range(fit):
                        runs.append((rank, made, k * length))
                        rank += whole
                    groups[room - fit * length].append((made, whole))
                    made, todo = made + whole, todo - whole * fit
                if todo:
                    for k in range(todo):
                        runs.append((rank, made, k * length))
                        rank += 1
                    groups[room - todo * length].append((made, 1))
                    made, todo = made + 1, 0
                break
            first, many = groups[left].pop()
            take = min(many, todo)
            if take < many:
                groups[left].append((first + take, many - take))
            runs.append((rank, first, room - left))
            rank, todo = rank + take, todo - take
            groups[left - length].append((first, take))
            left = min(left, max(length, left - length)) if left - length >= length else left
    return slots


class WordIds:
    """Ids of a text by a tokenizer that splits at white space: words between plain spaces are encoded once while cached. Where the
    tokenizer is one of NFC, lower case, letter runs, bytes and a BPE model, letters of Latin-1 between punctuation go to its model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.model = self.tokenizer.model if told["model"]["type"] == "BPE" and all(told[k] == v for k, v in STEPS.items()) else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        found = self.new.get(word)
        if found is not None:
            return found
        found = self.old.get(word)
        if found is None:
            found = self.fresh(word)
        if len(word) <= 64:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[word] = found
        return found

    def fresh(self, word: str) -> bytes:
        core = word.strip(AROUND)
        # NFC leaves Latin-1 alone, and a run of letters is split from punctuation on either side
        if self.model is None or not core.isalpha() or not (core.isascii() or max(core) <= "\xff"):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low = core.lower()
        if low != word:
            head, _, tail = word.partition(core)
            return b"".join([self.word(part) for part in (head, low, tail) if part])
        spelt = low if low.isascii() else low.encode().decode("latin-1").translate(BYTES)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def encode(self, text: str) -> bytes:
        get, word = self.new.get, self.word
        return b"".join([get(w) or word(w) for w in text.replace("\n", " ").split(" ")])


_TOKENIZERS: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer_file: str, room: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of each document with the task that made them and their rank among its pieces of that length."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        words = _TOKENIZERS.get(tokenizer_file) or _TOKENIZERS.setdefault(tokenizer_file, WordIds(tokenizer_file))
        task, seen = TaskContext.get().partitionId(), [0] * (room + 1)
        end = array("I", [end_id]).tobytes()
        for r in source:
            ids = words.encode(r["text"]) + end
            for piece, at in enumerate(range(0, len(ids), 4 * room)):
                part = ids[at : at + 4 * room]
                n = len(part) // 4
                out = (r["doc_id"], piece, at // 4, n, zlib.crc32(part), task, seen[n])
                seen[n] += 1
                yield (*out, np.frombuffer(part, "<u4").tolist()) if with_ids else out

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    return map_rows(clean(docs), schema + (", ids array<bigint>" if with_ids else ""), rows)


def pack_documents(docs: DataFrame, tokenizer_file: str, room: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (with_ids also ids) per piece of every row of docs.

    Each document is its ids and end_id, cut into pieces of room tokens if longer; pieces fill sequences of at most room without
    gaps. Null text counts as empty (end_id alone); rows of null or repeated doc_id are packed each; an empty table gives none.

    The pieces are written once with their task and their rank in it, so a lost executor cannot change a rank. Only the histogram
    (room numbers) and the plan (bounded by lengths times room left) are on the driver; a length that a third of all pieces have
    is ranked task by task, in no single task."""
    spark = ship(docs.sparkSession)
    pieces = materialise(token_pieces(docs, tokenizer_file, room, end_id, with_ids), "pieces")
    counts = materialise(pieces.groupBy("task", "length").count(), "lengths")
    slots = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, room)
    before = counts.withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = {n: tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) for n, runs in slots.items()}
    shared = spark.sparkContext.broadcast(starts)
    ranked = pieces.join(before.select("task", "length", "base"), ["task", "length"]).withColumn("slot", F.col("base") + F.col("rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = dict(pieces.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, slot = batch.column("length").to_numpy(), batch.column("slot").to_numpy()
            sequence, offset = np.empty(len(slot), np.int64), np.empty(len(slot), np.int64)
            for n in np.unique(length):
                at = length == n
                rank, first, place_ = shared.value[int(n)]
                run = np.searchsorted(rank, slot[at], side="right") - 1
                sequence[at], offset[at] = first[run] + slot[at] - rank[run], place_[run]
            columns = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
