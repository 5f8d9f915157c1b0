"""Exact substring deduplication: repeated strings of a least length, by breadth-first backward extension on a Burrows-Wheeler transform.

Equal strings of LEAST bytes have the same smallest GRAM-byte hash at the same place, so the text is cut into runs of window
starts that share that smallest hash, and only windows under equal hashes can be equal. Runs whose hash occurs once are left out
before any text moves. The bytes around the other runs (contexts) meet by hash; equal contexts are sent once, with a count. Each
batch of contexts is sorted into a Burrows-Wheeler transform, whose common prefixes are derived by rising value and no further
than LEAST. A hash with too many contexts is split by the bytes next to it until its groups are small or single windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.text import clean, map_rows, mix64, row_key, unused
from tracegrid.session import discard, materialise, ship, tidy

LEAST, GRAM, SEGMENT, BATCH, HEAVY = 400, 32, 1 << 18, 1 << 20, 2 << 20
PASSAGE, WORDS = 200, 50
CELLS = (64, 16, 4, 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0xB1))
_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    if not _POWERS:
        size = SEGMENT + 4096
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed rolling hash of the GRAM bytes at every place."""
    up, down = powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, by minima over spans that double."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:])


def chosen(grams: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The places whose hash is the smallest of some window: where it equals the largest of the minima of the windows over it."""
    width = len(grams) - len(low) + 1
    padded = np.full(len(low) + 2 * (width - 1), np.iinfo(np.uint64).max, np.uint64)
    padded[width - 1 : width - 1 + len(low)] = ~low
    return np.flatnonzero(grams == ~sliding_min(padded, width))


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def runs_of_parts(parts: list[bytes], least: int) -> Runs:
    """The runs of all parts, laid end to end, as places in the whole; windows across two parts are left out."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    width = least - GRAM + 1
    grams = gram_hashes(raw)
    owned = np.array([len(p) - least + 1 for p in parts])
    begin = np.cumsum([0, *map(len, parts[:-1])])
    window = np.arange(owned.sum()) + np.repeat(begin - np.cumsum(owned) + owned, owned)  # window starts
    least_of = sliding_min(grams, width)[window]
    low = np.zeros(len(raw) - least + 1, np.uint64)
    low[window] = least_of
    fresh = np.concatenate([[True], least_of[1:] != least_of[:-1]])
    fresh[np.cumsum(owned)[:-1]] = True
    first = np.flatnonzero(fresh)
    start, end = window[first], window[np.append(first[1:], len(window)) - 1] + 1
    spots = chosen(grams, low)
    key, value = low[start], grams[spots]
    known, count = np.unique(value, return_counts=True)
    times = np.minimum(2, count[np.searchsorted(known, key)])
    left, right = np.searchsorted(spots, start), np.searchsorted(spots, end + width - 1)
    many = right - left
    run = np.repeat(np.arange(len(start)), many)
    place = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(left, many)
    own = value[place] == key[run]
    run, place = run[own], place[own]
    only = np.bincount(run, minlength=len(start)) == 1
    spot = np.where(only, spots[place[np.searchsorted(run, np.arange(len(start)))]] - start, -1)
    return start, end, key, times, spot


def runs_of(texts: list[bytes], least: int) -> list[Runs]:
    """Start, end (of window starts), smallest hash, number of places that were smallest with that hash (at most 2 are told apart; more
    than one text can count to it), and the place in the run where its hash stands (-1: at several) of each run of each text. Short
    texts are laid end to end and long ones cut, so that numpy sees arrays of one size."""
    found: list[list[Runs]] = [[] for _ in texts]
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def settle_held() -> None:
        if held:
            columns = runs_of_parts([p for _, _, p in held], least)
            at = 0
            edges = np.searchsorted(columns[0], np.cumsum([len(p) for _, _, p in held]))
            shift = 0
            for (text, offset, part), stop in zip(held, edges, strict=True):
                start, end, *rest = (c[at:stop] for c in columns)
                found[text].append((start - shift + offset, end - shift + offset, *rest))
                at, shift = stop, shift + len(part)
            held.clear()

    for number, data in enumerate(texts):
        for at in range(0, len(data) - least + 1, SEGMENT):
            part = data[at : at + SEGMENT + least - 1]
            if size + len(part) > SEGMENT + 4096:
                settle_held()
                size = 0
            held.append((number, at, part))
            size += len(part)
    settle_held()
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return [tuple(np.concatenate(c) for c in zip(*f, strict=True)) if f else none for f in found]


def runs(data: bytes, least: int) -> Runs:
    return runs_of([data], least)[0]


def with_runs(source: Iterator[dict], least: int) -> Iterator[tuple[dict, bytes, Runs]]:
    """Each row with its text's bytes and runs; rows are gathered to about a segment of text."""
    held: list[tuple[dict, bytes]] = []
    size = 0
    for r in source:
        held.append((r, as_bytes(r["text"])))
        size += len(held[-1][1])
        if size >= SEGMENT:
            yield from ((*h, f) for h, f in zip(held, runs_of([d for _, d in held], least), strict=True))
            held, size = [], 0
    yield from ((*h, f) for h, f in zip(held, runs_of([d for _, d in held], least), strict=True))


def sorted_suffixes(text: np.ndarray, least: int) -> np.ndarray:
    """Order of the suffixes by at least their first `least` symbols (0..256), by doubling from packed symbols. A key and its place
    share one integer where they fit, as plain values sort much faster than an order."""
    n = len(text)
    code = np.zeros(257, np.int64)
    code[np.unique(text)] = 1
    code = np.cumsum(code)
    place, symbol = n.bit_length(), int(code[-1]).bit_length()
    span = max(1, (63 - place) // symbol)
    padded = np.zeros(n + span, np.int64)
    padded[:n] = code[text]
    key = np.zeros(n, np.int64)
    for k in range(span):
        key = (key << symbol) | padded[k : k + n]
    bits = span * symbol
    where = np.arange(n)
    while True:
        if bits + place <= 63:
            packed = np.sort((key << place) | where)
            order = packed & ((1 << place) - 1)
            ranked = packed >> place
        else:
            order = np.argsort(key)
            ranked = key[order]
        fresh = np.ones(n, np.int64)
        fresh[1:] = ranked[1:] != ranked[:-1]
        np.cumsum(fresh, out=fresh)
        if span >= least or fresh[-1] == n:
            return order
        rank = np.zeros(n + span, np.int64)
        rank[order] = fresh
        width = int(fresh[-1]).bit_length()
        key = (rank[:n] << width) | rank[span : span + n]
        bits, span = 2 * width, span * 2


def boundaries(text: np.ndarray, order: np.ndarray, least: int, separator: int = 256) -> np.ndarray:
    """Where, between neighbours in suffix order, the common prefix is shorter than `least`: True at the first of each group.

    Breadth-first: intervals of strings of length l are extended backward through the transform to those of length l + 1; an
    interval whose right border is new has common prefix l there and goes on, so each border is met once. Strings with a separator
    are not extended."""
    n = len(text)
    symbol = text[order - 1]
    step = np.empty(n, np.int32 if n < 1 << 31 else np.int64)  # where the suffix one symbol longer stands: equal symbols keep their order
    step[np.argsort(symbol, kind="stable")] = np.arange(n, dtype=step.dtype)
    stretch = np.cumsum(np.concatenate([[0], symbol[1:] != symbol[:-1]]), dtype=step.dtype)
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    lo, hi = np.array([0], step.dtype), np.array([n], step.dtype)
    for _ in range(least):
        if not len(lo):
            break
        # one symbol before the whole interval: it goes on as it is
        last = hi - 1
        same = stretch[lo] == stretch[last]
        going = same & (symbol[lo] != separator)
        new_lo, new_hi = step[lo[going]], step[last[going]] + 1
        if not same.all():
            many_lo, many = lo[~same].astype(np.int64), (hi[~same] - lo[~same]).astype(np.int64)
            at = np.repeat(many_lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            group = np.repeat(np.arange(len(many)), many)
            ok = symbol[at] != separator
            at, group = at[ok], group[ok]
            if len(at):
                k, at = np.divmod(np.sort((group * 512 + symbol[at]) * n + at), n)
                t = step[at]
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                new_lo = np.concatenate([new_lo, t[first]])
                new_hi = np.concatenate([new_hi, t[np.append(first[1:], len(t)) - 1] + 1])
        fresh = ~border[new_hi]
        lo, hi = new_lo[fresh], new_hi[fresh]
        border[hi] = True
    return border[:n]


def repeated_windows(bodies: list[bytes], owned: list[int], times: list[int], least: int) -> list[list[int]]:
    """For each body the starts of its first `owned` windows that occur at least twice over all bodies (each `times` times), as flat ranges [a, b, ...]."""
    sizes = np.array([len(b) + 1 for b in bodies])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.full(int(sizes.sum()), 256, np.int16)
    weight = np.zeros(len(text), np.int64)
    for body, at, own, many in zip(bodies, starts, owned, times, strict=True):
        text[at : at + len(body)] = np.frombuffer(body, np.uint8)
        weight[at : at + own] = many
    order = sorted_suffixes(text, least)
    first = np.flatnonzero(boundaries(text, order, least))
    counted = weight[order]
    total = np.add.reduceat(counted, first)
    member = np.repeat(total >= 2, np.diff(np.append(first, len(order))))
    hit = np.zeros(len(text) + 1, bool)
    hit[order] = member & (counted > 0)
    out = []
    for at, own in zip(starts, owned, strict=True):
        h = np.concatenate([[False], hit[at : at + own], [False]])
        out.append(np.flatnonzero(h[1:] != h[:-1]).tolist())
    return out


def pieces_of(body: bytes, owned: int, key: int, cell: int, least: int) -> Iterator[tuple[int, int, int, int]]:
    """Split a run's windows by the place of its smallest hash in them, in cells of so many places: (first window, number of windows,
    from, to): the last two are the bytes that all windows of the cell share, whoever's they are."""
    grams = gram_hashes(np.frombuffer(body, np.uint8)) if len(body) <= SEGMENT + 4096 else np.concatenate([gram_hashes(np.frombuffer(body[a : a + SEGMENT + GRAM - 1], np.uint8)) for a in range(0, len(body) - GRAM + 1, SEGMENT)])
    spots = np.flatnonzero(grams == np.array([key]).astype(np.int64).view(np.uint64)[0])
    window = np.arange(owned)
    p = spots[np.searchsorted(spots, window)]
    which = p * 1024 + (p - window) // cell
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    for a, b in zip(first, np.append(first[1:], owned), strict=True):
        c = int((p[a] - a) // cell)
        yield int(a), int(b - a), int(p[a] - c * cell), int(p[a] - (c + 1) * cell + 1 + least)


def as_bytes(text: str | bytes) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)


def find_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, key, spans: flat byte ranges [a, b, ...] of each document that strings of `least` bytes cover which start elsewhere
    too. docs: doc_id (not null), key (hash of the text), at (what to add to places in text: a text may be a stretch of a document),
    text (string or binary, not null). Documents without any are not listed. A run's place is its start (31 bits), number of windows
    (19 bits: a segment at most) and the place of its hash in it, plus one (13 bits), so that texts are hashed once."""
    assert least <= 4096
    id_type = dict(docs.dtypes)["doc_id"]
    # rows that repeat a doc_id and its text are one text that occurs so often
    docs = docs.filter(F.octet_length("text") >= least)

    def anchors(source: Iterator[dict]) -> Iterator[tuple]:
        for r, _, (start, end, key, times, spot) in with_runs(source, least):
            yield r["doc_id"], r["key"], r["at"], key.view(np.int64).tolist(), times.tolist(), (start << 32 | end - start << 13 | spot + 1).tolist()

    named = f"doc_id {id_type}, key long, at long"
    listed = map_rows(docs, f"{named}, anchor array<bigint>, times array<int>, place array<bigint>", anchors, per_batch=200)
    each = listed.select("doc_id", "key", "at", F.explode(F.arrays_zip("anchor", "times", "place")).alias("a"))
    found = materialise(each.select("doc_id", "key", "at", "a.anchor", "a.times", "a.place"), "anchors")
    shared = found.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor").hint("shuffle_hash")
    lists = found.join(shared, "anchor").groupBy("doc_id", "key", "at").agg(F.collect_set(F.struct("anchor", "place")).alias("a"))
    lists = lists.select("doc_id", "key", "at", F.col("a.anchor").alias("anchors"), F.col("a.place").alias("places"))

    def contexts(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            data = as_bytes(r["text"])
            for anchor, place in zip(r["anchors"], r["places"], strict=True):
                start, windows, spot = place >> 32, place >> 13 & 0x7FFFF, (place & 0x1FFF) - 1
                body = data[start : start + windows - 1 + least]
                yield r["doc_id"], r["key"], start + r["at"], anchor, xxhash.xxh3_128_digest(body), spot, body

    asked = docs.join(lists, ["doc_id", "key", "at"])
    placed = materialise(map_rows(asked, f"doc_id {id_type}, key long, start long, anchor long, context binary, spot int, body binary", contexts), "contexts")
    discard(found)
    contexts_of = placed.groupBy(F.col("anchor").alias("grp"), F.col("context").alias("piece")).agg(F.count("*").alias("times"), F.min("spot").alias("spot"), F.first("body").alias("body"))
    level, mapping = materialise(contexts_of.select("grp", "piece", "times", "spot", F.lit(0).cast("long").alias("off"), F.octet_length("body").alias("bytes"), "body"), "items"), None
    spent, verdicts = [level], []
    for cell in (*CELLS, None):
        heavy = too_large(level) if cell else None
        found = judged(level if heavy is None else level.join(heavy, "grp", "left_anti"), least)
        if mapping is None:
            verdicts.append(found.select(F.col("grp").alias("anchor"), F.col("piece").alias("root"), F.lit(0).cast("long").alias("off"), "found"))
        else:
            verdicts.append(mapping.select("grp", "piece", "anchor", "root", "off").join(found, ["grp", "piece"]).select("anchor", "root", "off", "found"))
        if heavy is None:
            break
        whole = level.withColumns({"anchor": F.col("grp"), "root": F.col("piece")}) if mapping is None else mapping
        mapping = materialise(split(whole.join(heavy, "grp", "left_semi"), cell, least), "pieces")
        pieces = mapping.groupBy("grp", "piece").agg(F.sum("times").alias("times"), F.min("spot").alias("spot"), F.min("off").alias("off"), F.first("body").alias("body"))
        level = materialise(pieces.select("grp", "piece", "times", "spot", "off", F.octet_length("body").alias("bytes"), "body"), "items")
        spent += [heavy, mapping, level]
    marked = verdicts[0]
    for v in verdicts[1:]:
        marked = marked.unionByName(v)
    marked = materialise(marked, "marked")
    hits = placed.select("doc_id", "key", "start", "anchor", F.col("context").alias("root")).join(marked, ["anchor", "root"])
    shifted = F.transform(F.col("found"), lambda x, i: F.col("start") + F.col("off") + x + F.when(i % 2 == 1, F.lit(least - 1)).otherwise(F.lit(0)))
    spans = materialise(hits.select("doc_id", "key", shifted.alias("s")).groupBy("doc_id", "key").agg(F.flatten(F.collect_set("s")).alias("spans")), "spans")
    discard(placed, marked, *spent)
    return spans


def too_large(items: DataFrame) -> DataFrame | None:
    """The groups of more than HEAVY bytes, or None where there is none."""
    heavy = materialise(items.groupBy("grp").agg(F.sum("bytes").alias("size")).filter(F.col("size") > HEAVY).select("grp"), "heavy")
    with tidy(items.sparkSession):
        return None if heavy.isEmpty() else heavy


def judged(items: DataFrame, least: int) -> DataFrame:
    """grp, piece, found: window ranges of each item that occur at least twice. items: grp, piece, times, spot, off, body."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        held: list[dict] = []
        size = 0
        for group in groups(source):
            if len(group) == 1 and group[0]["times"] > 1:  # its windows occur as often as it does
                yield group[0]["grp"], group[0]["piece"], [0, len(group[0]["body"]) - least + 1]
                continue
            part = possible(group, least)
            held += part
            size += sum(len(r["body"]) for r in part)
            if size >= BATCH:
                yield from settle(held, least)
                held, size = [], 0
        if held:
            yield from settle(held, least)

    dealt = items.select("grp", "piece", "times", "spot", "off", "body").repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp")
    return map_rows(dealt.sortWithinPartitions("grp"), "grp long, piece binary, found array<bigint>", rows)


def groups(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Neighbouring rows of one grp."""
    held: list[dict] = []
    for r in rows:
        if held and r["grp"] != held[0]["grp"]:
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def possible(group: list[dict], least: int) -> list[dict]:
    """The contexts of a group, cut to the windows that may occur twice. A window holds the group's hash in its first or in its
    second half, and all windows of a half share the bytes between; where no other context has these bytes, none of them repeats. With a
    hash that stands at several places of a context nothing is left out."""
    if len(group) == 1 and (group[0]["spot"] >= 0 or group[0]["off"]):
        return []  # a context can repeat within itself only with its hash at several places, a later cell of one not at all
    if any(r["spot"] < 0 for r in group):
        return [r | {"skip": 0} for r in group]
    half = (least - GRAM + 2) // 2
    seen: dict[tuple, int] = {}
    cores = []
    for r in group:
        body, p = r["body"], r["spot"]
        late = (1, body[p - half : p + GRAM]) if p >= half else None
        early = (0, body[p : p - half + 1 + least]) if p - (len(body) - least) < half else None
        cores.append((late, early))
        for c in (late, early):
            if c:
                seen[c] = seen.get(c, 0) + r["times"]
    out = []
    for r, (late, early) in zip(group, cores, strict=True):
        first, last = late is not None and seen[late] > 1, early is not None and seen[early] > 1
        if first or last:
            skip = 0 if first or late is None else r["spot"] - half + 1
            stop = len(r["body"]) if last or early is None else r["spot"] - half + least
            out.append(r | {"skip": skip, "body": r["body"][skip:stop]})
    return out


def settle(held: list[dict], least: int) -> Iterator[tuple]:
    found = repeated_windows([r["body"] for r in held], [len(r["body"]) - least + 1 for r in held], [r["times"] for r in held], least)
    for r, f in zip(held, found, strict=True):
        if f:
            yield r["grp"], r["piece"], [x + r["skip"] for x in f]


def split(items: DataFrame, cell: int, least: int) -> DataFrame:
    """The items of too large groups in finer cells; a cell's group is named by the bytes all its windows share."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            for first, many, a, b in pieces_of(r["body"], len(r["body"]) - least + 1, r["anchor"], cell, least):
                body = r["body"][first : first + many - 1 + least]
                grp = xxhash.xxh3_64_intdigest(r["body"][a:b], seed=cell) - (1 << 63)
                yield grp, xxhash.xxh3_128_digest(body), r["anchor"], r["root"], r["off"] + first, r["times"], -1, body

    schema = "grp long, piece binary, anchor long, root binary, off long, times long, spot int, body binary"
    return map_rows(items, schema, rows)


def merged(spans: list[int]) -> list[tuple[int, int]]:
    """Flat byte ranges as disjoint ones, those that touch joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept)


def keyed(docs: DataFrame) -> DataFrame:
    return clean(docs.filter("doc_id IS NOT NULL")).withColumn("key", row_key()).withColumn("at", F.lit(0).cast("long"))


def with_spans(docs: DataFrame, spans: DataFrame, *names: str) -> DataFrame:
    """docs with those columns of spans (doc_id, key, ...), null where nothing repeats. Rows that repeat a doc_id and its text count
    as many occurrences."""
    i, k = unused(docs, "_id", "_key")
    listed = spans.withColumnsRenamed({"doc_id": i, "key": k})
    return docs.join(listed, (docs["doc_id"] == listed[i]) & (row_key() == listed[k]), "left").select(*(docs[c] for c in docs.columns), *names)


def long_stretches(docs: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """doc_id, key, at, text (binary): the stretches of at least `least` bytes that the spans of shorter strings cover. A string of
    `least` bytes that occurs twice lies in one of them, and so does its other occurrence."""

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            data = as_bytes(r["text"])
            for a, b in merged(r["spans"]):
                if b - a >= least:
                    yield r["doc_id"], r["key"], a, data[a:b]

    return map_rows(docs.drop("at").join(spans, ["doc_id", "key"]), f"doc_id {dict(docs.dtypes)['doc_id']}, key long, at long, text binary", rows, per_batch=500)


def is_passage(part: bytes, words: int) -> bool:
    return len(part) >= LEAST or len(part.split()) > words


def remove_repeats(docs: DataFrame, least: int = LEAST, passage: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_bytes per row of docs: every byte is removed that a
    string of `least` bytes covers which starts anywhere else too, in the same document or another; matches do not cross documents.

    n_passages and n_passage_bytes report, removing nothing more, the stretches covered by strings of `passage` bytes (at most least)
    that start elsewhere too, as far as a stretch has more than `words` words or LEAST bytes. Strings of `least` bytes are looked
    for inside the stretches of the shorter ones, as none can lie elsewhere.

    Null text counts as empty; texts shorter than `least` are left alone, and rows without doc_id are neither changed nor matched.
    Rows that repeat a doc_id and its text match one another. Other columns are ignored; an empty table gives an empty result."""
    ship(docs.sparkSession)
    docs = clean(docs)
    short = find_repeats(keyed(docs), passage)
    stretches = materialise(long_stretches(keyed(docs), short, least), "stretches")
    long = find_repeats(stretches, least)
    discard(stretches)
    both = short.withColumnRenamed("spans", "short").join(long.withColumnRenamed("spans", "long"), ["doc_id", "key"], "left")

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        for r in source:
            data, spans = as_bytes(r["text"]), merged(r["long"] or [])
            passages = [b - a for a, b in merged(r["short"] or []) if is_passage(data[a:b], words)]
            yield r["doc_id"], len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut(data, spans)).hexdigest(), len(passages), sum(passages)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long"
    return map_rows(with_spans(docs, both, "short", "long"), schema, rows)


def dedup_text(docs: DataFrame, least: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """docs without the passages that occur more than once: stretches covered by strings of `least` bytes that start elsewhere too, as
    far as a stretch has more than `words` words or LEAST bytes. A character of which a stretch covers a part stays. All rows
    stay; other columns pass through, n_chars (if there) follows the text; null texts stay null."""
    ship(docs.sparkSession)
    name = unused(docs, "_spans")[0]
    joined = with_spans(docs, find_repeats(keyed(docs), least).withColumnRenamed("spans", name), name)
    names = docs.columns

    def one(t: str, spans: list[int]) -> str:
        data = as_bytes(t)
        whole = []
        for a, b in merged(spans):
            if not is_passage(data[a:b], words):
                continue
            while a < len(data) and data[a] & 0xC0 == 0x80:
                a += 1
            while b < len(data) and data[b] & 0xC0 == 0x80 and b > a:
                b -= 1
            whole.append((a, max(a, b)))
        return cut(data, whole).decode("utf-8", "surrogatepass")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(name).to_pylist()
            texts = [one(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) if s else c for t, s, c in zip(texts, spans, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(kept, docs.schema)
