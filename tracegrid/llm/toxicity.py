"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text, lengths compared window by window."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.text import clean, map_rows
from tracegrid.session import ship

TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES = 1500, 3000, 32 << 20
DICTIONARY, LEVEL, GRAM, CACHE, PAD = 16_384, 9, 5, 300_000, b"  "


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: dict  # (window length, toxic length, saving) -> log odds of a toxic document
    steps: tuple  # (least evidence, probability), rising
    trained: bool = True


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows(text: str | None) -> set[bytes]:
    """The distinct windows of a whole text: each word with the white space around it, ASCII lower-cased."""
    return {PAD + w + PAD for w in (text or "").encode("utf-8", "surrogatepass").lower().split()}


@lru_cache(40_000)
def grams(window: bytes) -> frozenset[bytes]:
    """The byte n-grams of a window, and the window whole."""
    inner = window[1:-1]
    return frozenset((inner, *(inner[i : i + GRAM] for i in range(len(inner) - GRAM + 1))))


def dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary; of too few samples to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes(), True
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-DICTIONARY:] or PAD * 8, False


class Lengths(dict):
    """Window to its cell: its length, its compressed length under the toxic dictionary, and how much that saves."""

    def __init__(self, model: Model):
        super().__init__()
        self.compress = []
        for raw in (model.toxic, model.ordinary):
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            d = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __missing__(self, window: bytes) -> tuple[int, int, int]:
        toxic, ordinary = (len(c(window)) for c in self.compress)
        if len(self) >= CACHE:
            self.clear()
        value = self[window] = (min(len(window), 28), min(toxic, 28), max(-4, min(ordinary - toxic, 12)))
        return value


def evidence(text: str | None, lengths: Lengths, weights: dict) -> float:
    """The strongest cell of the text, and a tenth of the next two: no window, no evidence."""
    found = sorted((weights.get(c, 0.0) for c in {lengths[w] for w in windows(text)}), reverse=True)[:3]
    return found[0] + 0.1 * sum(found[1:]) if found else -9.0


def log_odds(toxic: Counter, ordinary: Counter, n: int, m: int) -> dict:
    return {k: float(np.log((toxic[k] + 0.5) / (n + 1) / ((ordinary[k] + 0.5) / (m + 1)))) for k in toxic.keys() | ordinary.keys()}


def fit(toxic: list[str], ordinary: list[str], rate: float) -> Model:
    """rate: the share of toxic ones among all labelled rows. The toxic dictionary is trained on the windows of toxic documents whose
    byte n-grams ordinary documents lack (and a hundredth of the toxic ones have), the ordinary one on windows of a quarter of the ordinary documents;
    all rows weigh the length cells, and isotonic steps turn evidence into probability."""
    if not toxic or not ordinary:
        return Model(PAD * 8, PAD * 8, {}, ((-99.0, 1.0 if toxic else 0.0),), False)
    sets = [[windows(t) for t in part] for part in (toxic, ordinary)]
    counts = [Counter() for _ in sets]
    for count, part in zip(counts, sets, strict=True):
        for doc in part:
            count.update(set().union(*map(grams, doc)) if doc else ())
    odds = log_odds(*counts, len(toxic), len(ordinary))
    telling = {g for g, v in odds.items() if v > 2.5 and counts[0][g] >= min(len(toxic), max(3, 0.01 * len(toxic)))}
    # copies of a toxic document repeat its ordinary words too, but always after the same word
    after: dict[bytes, set] = {}
    for text in toxic:
        run = text.encode("utf-8", "surrogatepass").lower().split()
        for left, word in zip([b"", *run], run, strict=False):
            if (key := PAD[1:] + word + PAD[1:]) in telling:
                after.setdefault(key, set()).add(left)
    telling -= {g for g, lefts in after.items() if len(g) != GRAM and len(lefts) < min(len(toxic), max(3, 0.01 * len(toxic)))}
    marked = [w for doc in sets[0] for w in sorted(doc) if grams(w) & telling]
    plain = [w for doc in sets[1][: max(1, len(sets[1]) // 4)] for w in sorted(doc)]
    plain = plain[:: max(1, len(plain) // 100_000)]
    grams.cache_clear()
    a, b = dictionary(marked or [w for doc in sets[0] for w in sorted(doc)]), dictionary(plain)
    blank = Model(a[0], b[0], {}, ())
    lengths = Lengths(blank)
    cells = [Counter() for _ in sets]
    for count, part in zip(cells, sets, strict=True):
        for doc in part:
            count.update({lengths[w] for w in doc})
    weights = log_odds(*cells, len(toxic), len(ordinary))
    scores = [[evidence(t, lengths, weights) for t in part] for part in (toxic, ordinary)]
    share = (rate / len(toxic), (1 - rate) / len(ordinary))
    points = sorted([(s, 1.0, share[0]) for s in scores[0]] + [(s, 0.0, share[1]) for s in scores[1]])
    blocks: list[list[float]] = []  # least evidence, toxic weight, weight
    for s, y, w in points:
        if blocks and blocks[-1][0] == s:
            blocks[-1][1] += y * w
            blocks[-1][2] += w
        else:
            blocks.append([s, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, y1, w1 = blocks.pop()
            blocks[-1][1] += y1
            blocks[-1][2] += w1
    return Model(a[0], b[0], weights, tuple((s, y / w) for s, y, w in blocks))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Fit on a bounded sample: at most about toxic_rows and ordinary_rows labelled documents that are not held out, chosen by a hash
    of doc_id, and SAMPLE_BYTES of text in the order of that hash. Only text and the toxic label are learnt from."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("bad")).filter(~held_out())
    counts = {r["bad"]: r["count"] for r in known.groupBy("bad").count().collect()}
    take = F.when(F.col("bad"), min(1.0, toxic_rows / max(1, counts.get(True, 0)))).otherwise(min(1.0, ordinary_rows / max(1, counts.get(False, 0))))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < take * 1_000_000)
    sample = clean(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "bad").orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator(prefetchPartitions=True)
    parts: dict[bool, list] = {True: [], False: []}
    size = {True: 0, False: 0}
    for r in sample:
        if size[r["bad"]] < SAMPLE_BYTES // 2:
            size[r["bad"]] += len(r["text"])
            parts[r["bad"]].append((r["doc_id"], r["text"]))
    return fit([t for _, t in sorted(parts[True])], [t for _, t in sorted(parts[False])], counts.get(True, 0) / max(1, sum(counts.values())))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score per row: the calibrated probability that label 1 holds. Null text counts as empty and gets the lowest step."""
    ship(docs.sparkSession)
    least, probability = np.array([s for s, _ in model.steps]), [p for _, p in model.steps]

    def rows(source: Iterator[dict]) -> Iterator[tuple]:
        lengths = Lengths(model)
        for r in source:
            at = int(np.searchsorted(least, evidence(r["text"], lengths, model.weights), side="right")) - 1
            yield r["doc_id"], float(min(1.0, max(0.0, probability[max(0, at)])))

    return map_rows(clean(docs), f"doc_id {dict(docs.dtypes)['doc_id']}, score double", rows)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs. Labels only teach (of rows not held out); null labels and labels of unknown
    documents are passed over, and where no label or only one class is known every score is that class's. Null doc_ids are scored too,
    repeated rows alike; an empty table gives an empty result."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    ship(docs.sparkSession)
    model = train(docs, labels)
    least, probability = np.array([s for s, _ in model.steps]), [p for _, p in model.steps]

    def keep(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        lengths = Lengths(model)
        for batch in batches:
            texts = batch.column("text")
            found = [evidence(t.as_py(), lengths, model.weights) for t in texts]
            at = np.maximum(np.searchsorted(least, found, side="right") - 1, 0)
            yield batch.filter(pa.array([probability[i] < threshold for i in at], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
