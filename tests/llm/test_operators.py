"""The corpus operators against brute force, on small tables with nulls, ties, repeats, long and empty texts and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracegrid.llm import bpe, components, fingerprints, lines, neardup, packing, suffixes, toxicity, urls, vectors, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, u string, a string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randint(3, 160)) for _ in range(30)]
    passage = words(rng, 130)
    out = list(base)
    for t in base[:10]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [base[3]] * 4 + [t + "\n" + passage + "\n" + words(rng, 20) for t in base[10:18]]
    out += ["", "  ", "one", "ONE", "x" * 5000, "ab " * 700, "a\n\n  b\tc\r\n 😀 l'été 123456  don't", None, words(rng, 9000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "k", "u", "a") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, "no id", "en", None, 5, "k", "u", "a"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def union_find(ids, edges):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    want = union_find({i for e in edges for i in e}, edges)
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: c for i, c in want.items() if i in got} and all(want[i] == i for i in want.keys() - got.keys())
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    v = np.concatenate([base, base[:6] + rng.normal(size=(6, 8)) * 0.03, base[:3] * 2.5, base[:1], base[:1]])
    rows = [(int(i), x.tolist(), int(i) % 2 if i > 18 else 0, 1) for i, x in enumerate(v)]
    odd = [(100, None, 0, 1), (101, [0.0] * 8, 0, 1), (102, [float("nan")] * 8, 0, 1), (103, [1.0, None] + [0.0] * 6, 0, 1), (104, base[0].tolist(), None, 1), (105, [float("inf")] * 8, 0, 1), (None, base[0].tolist(), 0, 1), (106, [], 0, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, id int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    comp = union_find(range(len(v)), list(zip(*map(lambda a: a.tolist(), np.nonzero(near)), strict=True)))
    out = vectors.near_vectors(df, 0.98, cell=4).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out if r["vec_id"] is not None}
    assert len(out) == len(rows) + len(odd)
    assert {i: got[i] for i in range(len(v))} == {i: (int(near[i].sum()), comp[i], comp[i] == i) for i in range(len(v))}
    assert all(got[i] == (0, i, True) for i in range(100, 107))
    assert sum(r["audit_found"] for r in out) >= 0.9 * sum(r["audit_links"] for r in out)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_graph_search_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    x = np.concatenate([x, x[:400] + rng.normal(size=(400, 24)) * 0.02])
    _, true, found = vectors.search_block(vectors.unit(x), np.arange(len(x)), 0.98, audit_share=1.0)
    assert true >= 800 and found >= 0.9 * true


def test_graph_search_alone():
    """Groups of 1 to 60 near copies: what the search finds without the audit's repair, against brute force."""
    rng = np.random.default_rng(1)
    x = vectors.unit(np.concatenate([c + rng.normal(size=(n, 32)) * 0.015 for c, n in zip(rng.normal(size=(90, 32)), rng.integers(1, 61, 90), strict=True)]))
    graph, entries = vectors.build_graph(x)
    got = vectors.range_search(x, graph, entries, np.arange(len(x)), 0.98)
    np.fill_diagonal(got, False)
    want = vectors.scan(x, np.arange(len(x)), 0.98)
    assert want.sum() > 20_000 and (got & ~want).sum() == 0 and (got & want).sum() >= 0.99 * want.sum()


def test_graph_search_finds_a_loose_group_without_a_scan():
    """A group of 900 whose members are within range of only a part of it, among vectors without links."""
    rng = np.random.default_rng(6)
    group = rng.normal(size=64) / 8 + rng.normal(size=(900, 64)) * rng.uniform(0.008, 0.03, (900, 1))
    x = vectors.unit(np.concatenate([group, rng.normal(size=(3000, 64)) / 8])[rng.permutation(3900)])
    want = vectors.scan(x, np.arange(len(x)), 0.98 - 1e-9)
    hits, true, found = vectors.search_block(x, np.arange(len(x)), 0.98, audit_share=1.0)
    assert 100_000 < want.sum() < 800_000 and true == want.sum() and found >= 0.9999 * true
    assert [h.tolist() for h in hits] == [np.flatnonzero(m).tolist() for m in want]


def test_a_block_where_the_search_misses_is_scanned(monkeypatch):
    rng = np.random.default_rng(2)
    x = vectors.unit(np.repeat(rng.normal(size=(40, 8)), 5, axis=0) + rng.normal(size=(200, 8)) * 0.01)
    monkeypatch.setattr(vectors, "range_search", lambda x, graph, entries, queries, least: np.zeros((len(queries), len(x)), bool))
    hits, true, found = vectors.search_block(x, np.arange(len(x)), 0.98)
    assert found == 0 < true and [h.tolist() for h in hits] == [np.flatnonzero(m).tolist() for m in vectors.scan(x, np.arange(len(x)), 0.98 - 1e-9)]


def test_bpe_documents(docs, plain):
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t in plain:
        ids = enc.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), tuple(ids)] += 1
    assert got == want


def test_bpe_spaces():
    e = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    rng = random.Random(0)
    for _ in range(400):
        t = "".join(rng.choice([" ", " ", "\n", "\t", " ", "a", "b1", "'s", "é", ".", "  "]) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == enc.encode_ordinary(t)
        assert e.decode(e.encode(t)) == t.encode()
    long = "".join(rng.choice("abcde") for _ in range(3000))
    assert bpe.merge_long(long.encode(), e.ranks) == enc.encode_ordinary(long)


def test_bpe_native_form(spark):
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = [" thandre", "été", "aaaaaaa", " x", "1234", "."]
    spark.conf.set("spark.sql.maxPlanStringLength", "10000")
    df = spark.createDataFrame([(w.encode(),) for w in found], "word binary")
    out = bpe.encode_words_native(df, ranks).select("word", "ids", bpe.decode_native(F.col("ids"), ranks).alias("back")).collect()
    assert all(r["ids"] == enc.encode_ordinary(bytes(r["word"]).decode()) and r["back"] == r["word"] for r in out) and len(out) == len(found)


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["scumbagly", "idioticus", "worthlessy"]
    rows, labels = [], []
    for i in range(900):
        w = words(rng, 30).split(" ")
        toxic = i % 6 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        if i % 5:
            labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (99999, 1)]
    rows += [(5000, ""), (5001, None), (None, "idioticus")]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(d, lab).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held) and len(held) > 100
    by = {r["doc_id"]: r["predicted"] for r in held}
    assert np.mean([by[i] for i in by if i < 900 and i % 6 == 0]) > 0.9 and np.mean([by[i] for i in by if i < 900 and i % 6]) < 0.05
    empty = {r["doc_id"]: r["score"] for r in out if (r["doc_id"] or 0) >= 5000}
    assert empty[5000] == empty[5001] < 0.3
    kept = toxicity.without_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(1 - r["predicted"] for r in out)
    assert {r["score"] for r in toxicity.toxicity(d, lab.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), lab).count() == 0


def test_fingerprints(spark, docs, plain):
    unique = [(i, t) for i, t in dict(sorted(((i, t) for i, t in plain if i is not None), key=lambda r: r[0])).items()][::-1]
    d = spark.createDataFrame([(*r, "x", "y") for r in unique], "doc_id long, text string, tie string, block string")
    for per in (7, 2000):
        got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(d, rows_per_block=per).collect()}
        assert len(got) == len(unique)
        for k, (i, t) in enumerate(unique):
            after = unique[(k + 1) % len(unique)][1]
            cut = len(t) // 3
            edited = t[: len(t) - cut] + after[:cut] if cut else t
            r = got[i]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["fingerprint"] == fingerprints.text_signature(t, 5).tobytes().hex()
            assert r["near_next"] == fingerprints.likeness(fingerprints.text_signature(t, 5), fingerprints.text_signature(after, 5))
            assert r["near_edited"] == fingerprints.likeness(fingerprints.text_signature(t, 5), fingerprints.text_signature(edited, 5))
    assert fingerprints.edited_fingerprints(docs, rows_per_block=9).count() == len(plain)
    assert fingerprints.edited_fingerprints(d.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(d.filter("doc_id = 1")).first()
    assert one["near_next"] == 1.0
    # ids that are not numbers, in their own order
    named = [(f"{i:05d}", t) for i, t in unique if t is not None]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.edited_fingerprints(spark.createDataFrame(named, "doc_id string, text string"), rows_per_block=7).collect()}
    for k, (i, t) in enumerate(named):
        cut = len(t) // 3
        assert got[i] == hashlib.sha256((t[: len(t) - cut] + named[(k + 1) % len(named)][1][:cut] if cut else t).encode()).hexdigest()


def sets(plain, width):
    out = {}
    for i, t in plain:
        w = t.encode().lower().split()
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    return out


def links(shingles, percent):
    ids = sorted(shingles)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if shingles[a] and shingles[b] and 100 * len(shingles[a] & shingles[b]) >= percent * len(shingles[a] | shingles[b])]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, plain, width):
    shingles = sets([(i, t) for i, t in plain if i is not None], width)
    comp = union_find(shingles, links(shingles, 80))
    out = neardup.near_duplicates(docs, width).collect()
    assert len(out) == len(plain)
    for r in out:
        i = r["doc_id"]
        if i is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(shingles[i]), comp[i], comp[i] == i)
    kept = neardup.keep_one(docs, width)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in out)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicate_chain(spark):
    """A chain whose ends are far apart: no star holds all its links."""
    w = [f"w{k}" for k in range(120)]
    rows = [(9 - k, " ".join(w[4 * k : 4 * k + 80])) for k in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    shingles = sets(rows, 2)
    comp = union_find(shingles, links(shingles, 80))
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(d, 2).collect()} == comp and len(set(comp.values())) == 1


def test_fingerprint_pairs(docs, plain):
    shingles = sets([(i, t) for i, t in plain if i is not None], 5)
    got = {tuple(r) for r in fingerprints.fingerprint_pairs(docs).select("u", "v").collect()}
    want = set(links(shingles, 80))
    assert got <= want and union_find(shingles, got) == union_find(shingles, want)


def test_fingerprint_pairs_of_one_signature(spark):
    b = [f"w{k}" for k in range(1804)]  # 1800 shingles
    c = b[:1604] + [f"v{k}" for k in range(200)]  # 1600 of them in 2000: just alike
    own = fingerprints.text_signature(" ".join(b), 5)
    a = next(t for t in (b[:p] + ["z"] + b[p + 1 :] for p in range(10, 1590)) if (fingerprints.text_signature(" ".join(t), 5) == own).all())
    got = fingerprints.fingerprint_pairs(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "doc_id long, text string"))
    assert {tuple(sorted(r)) for r in got.collect()} == {(1, 2), (2, 3)}


def test_plan_is_best_fit():
    for seed in range(60):
        rng = random.Random(seed)
        room = rng.choice([8, 20, 64])
        counts = {rng.randint(1, room): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        bins = defaultdict(list)
        for length, runs in packing.plan(counts, room).items():
            starts = [r[0] for r in runs]
            assert starts == sorted(starts)
            for k in range(counts[length]):
                rank, first, offset = runs[np.searchsorted(starts, k, side="right") - 1]
                bins[first + k - rank].append((offset, length))
        left = []
        for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fits = [(x, i) for i, x in enumerate(left) if x >= length]
            if fits:
                left[min(fits)[1]] -= length
            else:
                left.append(room - length)
        assert len(bins) <= len(left)
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= room


def test_packing_words_of_letters(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    words_ = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    whole = words_.tokenizer
    letters = "abcZÀÉßÿªºµæé"
    around = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0«\xa0\u0301\u0338İſΣςłﬁ日\U0001f600\t\x1c\u2028"
    rng = random.Random(8)
    some = ["", "'s", "it's", "'tis", "<|endoftext|>", "(<|endoftext|>)", "a<|startoftext|>b", "e\u0301", ".\u0338", "aaa\u0345", "x" * 70, "Ends.&&&", "İ.", "ªº", "ΟΔΟΣ", "ŉ", "don't!", "--", "42", "a1b"]
    some += ["".join(rng.choice(letters + around * (k % 3 == 0)) for _ in range(rng.randint(1, 7))) for k in range(3000)]
    some += [rng.choice(around) + "".join(rng.choice(letters) for _ in range(4)) + rng.choice(around) * 2 for _ in range(3000)]
    some += [a + "b" + c for a in map(chr, range(32, 0x250)) for c in ("", "é")] + ["é" + a for a in map(chr, range(32, 0x250))]
    for w in some:
        assert np.frombuffer(words_.encode(w), "<u4").tolist() == whole.encode(w, add_special_tokens=False).ids, ascii(w)
    text = " ".join(some)
    assert np.frombuffer(words_.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    # words of letters, with punctuation around them or not, do without the whole tokenizer
    known, words_.new, words_.old, words_.tokenizer = whole.encode("Plain ÉTÉ, words:", add_special_tokens=False).ids, {",": words_.word(","), ":": words_.word(":")}, {}, None
    assert np.frombuffer(words_.encode("Plain ÉTÉ, words:"), "<u4").tolist() == known


def test_packing(docs, plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = Counter(), 0
    for i, text in plain:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), room=256).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-total // 256) + 2
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_warc(spark, tmp_path):
    big, other = "<p>" + "é" * 900, "y" * 1000
    rows = [(1, "http://a/x", big), (2, "http://a\r\nb", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", other), (9, "u", other), (10, "u", "z" * 999), (11, "u", "z" * 999)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, file int")
    index = warc.write_archive(pages, str(tmp_path))
    out = warc.read_archive(index, str(tmp_path), with_payload=True).collect()
    keeper = {big: 3, other: 9}
    want = Counter()
    for i, _, h in rows:
        h = h or ""
        k = keeper.get(h, i)
        want[i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "response" if k == i else "revisit", None if k == i else k, h.encode() if k == i else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in out) == want
    some = warc.read_archive(index.filter("page_id IN (2, 8)"), str(tmp_path)).collect()
    assert sorted((r["page_id"], r["url"]) for r in some) == [(2, "http://a%0D%0Ab"), (8, "u")]
    assert warc.round_trip(pages.limit(0)).count() == 0
    named = pages.select(F.when(F.col("page_id") != 1, F.concat(F.lit("é/<"), F.lpad(F.col("page_id").cast("string"), 2, "0"))).alias("page_id"), "url", "html")
    back = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(named).collect()}
    assert (None, "response", None) in back and ("é/<02", "revisit", "é/<03") in back and ("é/<09", "response", None) in back


def test_ranges():
    e = [{"file": "a", "offset": o, "length": 10} for o in (0, 10, 25, 200)] + [{"file": "b", "offset": 200, "length": 10}]
    assert [[x["offset"] for x in run] for run in warc.ranges(e, gap=5, most=100)] == [[0, 10, 25], [200], [200]]


def test_lines(spark):
    rng = random.Random(8)
    block = [words(rng, 6) for _ in range(14)]
    rows = [(i, "\n".join([*(words(rng, 5) for _ in range(rng.randint(1, 6))), *(block if i % 2 else []), *(words(rng, 5) for _ in range(3))])) for i in range(12)]
    rows += [(50, None), (51, ""), (52, "one line"), (53, rows[0][1]), (53, rows[0][1]), (None, rows[1][1])]
    d = spark.createDataFrame([(*r, "h", len(r[1] or "")) for r in rows], "doc_id long, text string, drop string, n_chars long")
    out = lines.dedup_lines(d).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows) and all(r["n_chars"] == len(r["text"] or "") for r in out)
    spots = defaultdict(set)
    for i, t in rows:
        if i is not None and t:
            for k, body in lines.multi_line(t):
                spots[body].add((i, k))
    drop = defaultdict(set)
    for held in spots.values():
        for i, k in sorted(held)[1:]:
            drop[i].add(k)
    want = Counter((i, t if not drop[i] or i is None else lines.without(t, drop[i])[0]) for i, t in rows)
    assert Counter((r["doc_id"], r["text"]) for r in out) == want and sum(map(len, drop.values())) > 5
    assert lines.dedup_lines(d.limit(0)).count() == 0
    odd = d.select("doc_id", "text", *(F.lit(c).alias(c) for c in ("_id", "_key", "_drop", "_all", "n_removed_lines")))
    other = lines.dedup_lines(odd)
    assert other.columns == [*odd.columns[:-1], "n_removed_lines"] and Counter((r["doc_id"], r["text"], r["_id"], r["_drop"]) for r in other.collect()) == Counter({(*k, "_id", "_drop"): n for k, n in want.items()})


def test_lines_shifted(spark):
    """A passage of lines behind openings of different lengths, and within other passages, goes everywhere but where it is first."""
    rng = random.Random(12)
    passage = [words(rng, 7) for _ in range(12)]
    rows = [(i, "\n".join([words(rng, 4) for _ in range(i)] + passage[i % 3 :] + [words(rng, 4) for _ in range(9 - i)])) for i in range(9)]
    got = {r["doc_id"]: r["text"].split("\n") for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == (t.split("\n") if i == 0 else [line for line in t.split("\n") if line not in passage])


def repeated_lines(texts):
    """Of each text the numbers of the lines in runs of two or more, one of them not blank, that an earlier place has."""
    seen = {}  # the first (text, line) of each run
    parts = [t.split("\n") for t in texts]
    runs = [(i, a, b) for i, p in enumerate(parts) for a in range(len(p)) for b in range(a + 2, len(p) + 1) if any(s.strip() for s in p[a:b])]
    for i, a, b in runs:
        seen.setdefault(tuple(parts[i][a:b]), (i, a))
    gone = defaultdict(set)
    for i, a, b in runs:
        j, at = seen[tuple(parts[i][a:b])]
        if j < i or a >= at + b - a:
            gone[i].update(range(a, b))
    return gone


def test_lines_are_whole_runs(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["", "", " ", *"abcdefghij"]) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    passages = [[words(rng, 5) for _ in range(n)] for n in (2, 3, 4, 20)]
    for p in passages:
        texts += ["\n".join([words(rng, 5), *p, words(rng, 5)]) for _ in range(4)]
    texts += [texts[-1], "a\na\na\na\na\na", "q\n\n\n\nr\ns", "t\nq\n\n\n\nr", "q\n\n\n\n\nr"]
    parts, gone = [t.split("\n") for t in texts], repeated_lines(texts)
    out = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in out}
    assert got == {i: ("\n".join(s for k, s in enumerate(p) if k not in gone[i]), len(gone[i])) for i, p in enumerate(parts)}
    for n, p in enumerate(passages):
        assert all(len(gone[60 + 4 * n + k]) == len(p) for k in range(1, 4))


def covered(plain, least):
    """Of each row, the bytes that strings of that length cover which start elsewhere too, and the stretches they make."""
    seen = Counter()
    for i, t in plain:
        if i is not None:
            b = t.encode()
            seen.update(b[k : k + least] for k in range(len(b) - least + 1))
    for i, t in plain:
        b = t.encode()
        hit = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - least + 1):
                if seen[b[k : k + least]] > 1:
                    hit[k : k + least] = True
        edges = np.diff(np.concatenate([[0], hit.astype(int), [0]]))
        yield hit, list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def removed(plain, least, passage):
    out = Counter()
    for (i, t), (hit, spans), (_, short) in zip(plain, covered(plain, least), covered(plain, passage), strict=True):
        b = t.encode()
        sizes = [z - a for a, z in short if z - a >= 400 or len(b[a:z].split()) > 50]
        out[i, len(b), int(hit.sum()), len(spans), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest(), len(sizes), sum(sizes)] += 1
    return out


@pytest.mark.parametrize("heavy", [1 << 21, 3000])
def test_suffixes(docs, plain, monkeypatch, heavy):
    monkeypatch.setattr(suffixes, "HEAVY", heavy)
    got = Counter(tuple(r) for r in suffixes.remove_repeats(docs).collect())
    want = removed(plain, 400, 200)
    assert got == want and sum(r[6] > r[2] for r in want) > 3


def test_suffixes_of_short_alphabets(spark):
    """Strings with many places of one hash, within a text and between texts."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(["ab" * rng.randint(1, 300), "abc" * rng.randint(1, 300), words(rng, 12)]) for _ in range(rng.randint(1, 5)))) for i in range(25)]
    got = Counter(tuple(r) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == removed(rows, 400, 200)


def test_run_places():
    rng = random.Random(9)
    data = (words(rng, 400) + "xy" * 500 + words(rng, 50)).encode()
    start, end, key, _, spot = suffixes.runs(data, 400)
    grams = suffixes.gram_hashes(np.frombuffer(data, np.uint8))
    for a, b, k, s in zip(start, end, key, spot, strict=True):
        at = np.flatnonzero(grams[a : b - 1 + 400 - suffixes.GRAM + 1] == k)
        assert s == (at[0] if len(at) == 1 else -1)


def test_suffix_text_is_cut_where_passages_repeat(spark):
    rng = random.Random(10)
    passage, brief = words(rng, 55)[:330].rsplit(" ", 1)[0], words(rng, 45)
    assert len(passage.split()) > 50
    rows = [(i, "\n".join([words(rng, 40), [passage, brief, words(rng, 60)][i % 3], words(rng, 30)])) for i in range(9)]
    out = {r["doc_id"]: r["text"] for r in suffixes.dedup_text(spark.createDataFrame([(*r, "s", "k") for r in rows], "doc_id long, text string, _spans string, _key string")).collect()}
    for i, t in rows:
        assert (passage not in out[i] and len(out[i]) <= len(t) - len(passage)) if i % 3 == 0 else out[i] == t


def test_suffix_text_keeps_characters(docs):
    out = suffixes.dedup_text(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("n_chars <> char_length(text)").count() == 0
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_transform_borders():
    rng = random.Random(4)
    for _ in range(60):
        bodies = ["".join(rng.choice("ab") for _ in range(rng.randint(8, 60))).encode() for _ in range(rng.randint(1, 5))]
        times = [rng.choice([1, 1, 2]) for _ in bodies]
        owned = [len(b) - 8 + 1 for b in bodies]
        seen = Counter()
        for b, m in zip(bodies, times, strict=True):
            for k in range(len(b) - 7):
                seen[b[k : k + 8]] += m
        for b, spans in zip(bodies, suffixes.repeated_windows(bodies, owned, times, 8), strict=True):
            got = {k for a, z in zip(spans[::2], spans[1::2], strict=True) for k in range(a, z)}
            assert got == {k for k in range(len(b) - 7) if seen[b[k : k + 8]] > 1}


def test_urls(spark):
    rows = ["http://Shop.EXAMPLE.com/en/1?q#x", "https://www.example.com/en/2", "http://a.net/es/", "ftp://b.net:80/fr/x?y", "http://x.com", "http://x.com?/", "no url", None, "http://bad.org/p", "http://notexample.com/en/", "http://Ä.net/fr"]
    pages = spark.createDataFrame([(i, u, "d", 1) for i, u in enumerate(rows)] + [(100 + i, "http://bad.org/q", "d", 1) for i in range(40)] + [(200 + i, f"http://good{i % 4}.org/q", "d", 1) for i in range(40)], "page_id long, url string, domain string, n int")
    outcomes = spark.createDataFrame([(100 + i, True) for i in range(40)] + [(200 + i, i == 0) for i in range(40)] + [(None, True), (7777, True), (8, None)], "page_id long, bad boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, outcomes).collect()}
    assert got[0] == ("shop.example.com", "/en/1", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[2] == ("a.net", "/es/", "net/es/", "block") and got[3] == ("b.net:80", "/fr/x", None, got[3][3])
    assert got[4][:3] == ("x.com", "", None) and got[5][:3] == ("x.com", "", None) and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None)
    assert got[8] == ("bad.org", "/p", None, "block") and got[200][3] == "allow" and got[9][2] == "com/" and got[10][:3] == ("Ä.net", "/fr", None)
    assert urls.judge_urls(pages.limit(0), outcomes).count() == 0
    ends = ["shop.a.co.uk", "a.co.uk", "10.0.0.1", "[::1]", "x.y.z", "y.z", "z", "me@x.y.z:8080"]
    of = {r["h"]: (r["d"], r["s"]) for r in spark.createDataFrame([(e,) for e in ends], "h string").select("h", *(c.alias(n) for c, n in zip(urls.parents(F.col("h")), "ds", strict=True))).collect()}
    assert of == dict(zip(ends, [("a.co.uk", "co.uk"), ("a.co.uk", "co.uk"), ("10.0.0.1", "[address]"), ("[::1]", "[address]"), ("y.z", "z"), ("y.z", "z"), ("z", "z"), ("y.z", "z")], strict=True))
    assert {r["verdict"] for r in urls.judge_urls(pages, outcomes.limit(0)).collect() if r["page_id"] >= 100} == {"allow"}


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (30, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, current, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{k}")
        current = spark.read.parquet(f"{tmp_path}/{k}")
    left = {r["doc_id"] for r in current.collect()}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == left and len(left) > 20


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(21)
    plain = lambda n: words(rng, n).replace("é", "f")
    passage, block = plain(70), [plain(6) for _ in range(4)]
    texts = [plain(rng.randint(20, 90)) for _ in range(24)]
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts[:6]] + [texts[7]] * 2
    texts += [" ".join([plain(30), passage, plain(25)]) for _ in range(4)] + ["\n".join([plain(9), *block, plain(8)]) for _ in range(4)]
    texts += [plain(20) + " scumbagly " + plain(20) for _ in range(30)] + ["", "word"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, (len(rows), None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    known = [(i, 1, int("scumbagly" in t)) for i, t in enumerate(texts) if i % 3]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = {-1: spark.read.parquet(f"{tmp_path}/documents.parquet")}
    texts_of = lambda df: [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs[k - 1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs[k] = spark.read.parquet(f"{tmp_path}/{name}")
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    before, after = texts_of(docs[-1]), texts_of(docs[0])
    judged = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs[-1], spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert after == [r for r in before if not judged[r[0]]] and not any("scumbagly" in (t or "") for _, t in after) and len(after) >= 40
    before, after = after, texts_of(docs[1])
    gone = repeated_lines([t or "" for _, t in before])
    assert after == [(i, t if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if n not in gone[k])) for k, (i, t) in enumerate(before)] and sum(map(len, gone.values())) == 12
    before, after = after, texts_of(docs[2])
    comp = union_find([i for i, _ in before], links(sets([(i, t or "") for i, t in before], 5), 80))
    assert after == [r for r in before if comp[r[0]] == r[0]] and len(after) < len(before)
    before, after = after, texts_of(docs[3])
    want = []
    for (i, t), (_, spans) in zip(before, covered([(i, t or "") for i, t in before], 200), strict=True):
        for a, b in reversed([x for x in spans if x[1] - x[0] >= 400 or len(t[x[0] : x[1]].split()) > 50]):
            t = t[:a] + t[b:]
        want.append((i, t))
    assert after == want and sum(a != b for a, b in zip(before, after, strict=True)) == 4
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(t.encode(text or "", add_special_tokens=False).ids) + 1 for i, text in after}
    pieces = docs[4].collect()
    held = defaultdict(int)
    for r in pieces:
        held[r["doc_id"]] += r["length"]
    assert held == sizes and len({r["sequence_id"] for r in pieces}) == -(-sum(sizes.values()) // 2048)
    ran = corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset")
    assert Counter(map(tuple, ran.collect())) == Counter(tuple(r) for r in docs[4].select(ran.columns).collect())
