"""Embedding near-duplicates: robust-pruned flat graphs on overlapping cluster shards, searched greedily from medoids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.components import connected_components
from tracegrid.session import discard, materialise, ship

CELL, SAMPLE, MAX_CELLS, AUDIT = 20_000, 20_000, 1024, 0.125


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres by farthest-first seeds and Lloyd steps; deterministic."""
    seeds = [0]
    near = np.full(len(x), np.inf)
    while len(seeds) < min(k, len(x)):
        near = np.minimum(near, ((x - x[seeds[-1]]) ** 2).sum(1))
        seeds.append(int(near.argmax()))
    c = x[seeds].copy()
    for _ in range(rounds):
        at = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        count = np.bincount(at, minlength=len(c))
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and a matrix of the cells in which a vector within reach (a chord) of it may have its home:
    such a vector lies at most reach beyond the plane halfway between the two centres."""
    score = x @ c.T - (c * c).sum(1) / 2
    home = score.argmax(1)
    gap = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-300))
    return home, (score[np.arange(len(x)), home][:, None] - score) / gap[home] <= reach * (1 + 1e-9) + 1e-9


def build_graph(x: np.ndarray, degree: int = 20, pool: int = 48, shard: int = 600, alpha: float = 1.2) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency (ids a row, own id for none) and entry points. The vectors are dealt to overlapping shards, each to its two nearest
    centres; each shard builds its own pruned lists over its nearest members; the lists of a vector are united. Entries: medoids."""
    n = len(x)
    c = k_means(x, max(1, math.ceil(2 * n / shard)), 6)
    order = np.argsort(-(x @ c.T - (c * c).sum(1) / 2), axis=1, kind="stable")[:, :2]
    lists: list[list[np.ndarray]] = [[] for _ in range(n)]
    medoids = []
    for k in range(len(c)):
        members = np.flatnonzero((order == k).any(1))
        if not len(members):
            continue
        medoids.append(members[(x[members] @ c[k]).argmax()])
        for part in range(0, len(members), 4 * shard):  # a shard of many near copies is dealt into blocks
            m = members[part : part + 4 * shard]
            y = x[m]
            take = min(pool, len(m) - 1)
            if not take:
                continue
            adjacent = np.empty((len(m), degree), np.int64)
            near = np.empty((len(m), take), np.int64)
            for a in range(0, len(m), 256):
                sims = y[a : a + 256] @ y.T
                sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
                top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
                near[a : a + 256] = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)
            for a in range(0, len(m), 512):
                rows = np.arange(a, min(a + 512, len(m)))
                adjacent[rows] = robust_prune(y, rows, near[rows], degree, alpha)
            for i, node in enumerate(m):
                lists[node].append(m[adjacent[i]])
    for node in medoids:  # shards stay connected: medoids know each other
        lists[node].append(np.array(medoids[:degree]))
    united = [np.unique(np.concatenate(p)) if p else np.array([i]) for i, p in enumerate(lists)]
    width = max(map(len, united))
    graph = np.repeat(np.arange(n)[:, None], width, axis=1)
    for i, p in enumerate(united):
        graph[i, : len(p)] = p
    return graph, np.array(sorted(set(medoids)))


def robust_prune(y: np.ndarray, rows: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each of the rows its candidates in near, thinned: a candidate that lies alpha times nearer to a chosen neighbour than to
    the row is dropped. Up to degree ids a row, filled up with the row's own id."""
    distance = 1 - np.einsum("md,mcd->mc", y[rows], y[near])
    alive = np.ones(near.shape, bool)
    chosen = np.repeat(rows[:, None], degree, axis=1)
    line = np.arange(len(rows))
    cand = y[near]
    for r in range(degree):
        pick = np.where(alive, distance, np.inf).argmin(1)
        some = alive[line, pick]
        if not some.any():
            break
        node = near[line, pick]
        chosen[some, r] = node[some]
        between = 1 - np.einsum("md,mcd->mc", y[node], cand)
        alive &= ~(some[:, None] & (alpha * between <= distance))
        alive[line, pick] = False
    return chosen


def range_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, least: float, budget: int = 16, width: int = 4, beam: int = 48) -> np.ndarray:
    """Greedy best-first search of the graph for each query row (an id), width nodes at a time, from the query's own node and the
    entries: budget expansions to reach the neighbourhood, then on while any visited vector within range is unexpanded. The nodes to
    expand are kept in a beam, so a round costs the neighbours that it sees, not the table. Boolean matrix of the hits."""
    n = len(x)
    hits = np.zeros((len(queries), n), bool)
    seen = np.zeros((len(queries), n), bool)
    target = x[queries]
    line = np.arange(len(queries))
    hits[line, queries] = True
    seen[line, queries] = True
    first = (target @ x[entries].T)[:, :, None] if len(entries) else np.empty((len(queries), 0, 1))
    first[entries[None, :, None] == queries[:, None, None]] = -np.inf
    row, col = np.nonzero(first[:, :, 0] >= least)
    hits[row, entries[col]] = True
    seen[:, entries] = True
    nodes = np.concatenate([queries[:, None], np.broadcast_to(entries, (len(queries), len(entries)))], axis=1)
    sims = np.concatenate([np.ones((len(queries), 1)), first[:, :, 0]], axis=1)
    active, spent = line, 0
    while len(active):
        if sims.shape[1] > beam:
            # nodes within range are never dropped from the beam
            keep = max(beam, int((sims >= least).sum(1).max()))
            if sims.shape[1] > keep:
                top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
                nodes, sims = np.take_along_axis(nodes, top, 1), np.take_along_axis(sims, top, 1)
        take = min(width, sims.shape[1])
        top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        best = np.take_along_axis(sims, top, 1)
        usable = best > -np.inf if spent < budget else best >= least
        going = usable.any(1)
        if not going.all():
            active, nodes, sims, top, usable = active[going], nodes[going], sims[going], top[going], usable[going]
        if not len(active):
            break
        node = np.take_along_axis(nodes, top, 1)
        np.put_along_axis(sims, top, np.where(usable, -np.inf, np.take_along_axis(sims, top, 1)), 1)
        around = graph[node].reshape(len(active), -1)
        fresh = ~seen[active[:, None], around] & np.repeat(usable, graph.shape[1], axis=1)
        r, c = np.nonzero(fresh)
        a = around[r, c]
        key = active[r] * n + a
        _, once = np.unique(key, return_index=True)
        r, a = r[once], a[once]
        seen[active[r], a] = True
        sim = np.einsum("ij,ij->i", target[active[r]], x[a])
        hits[active[r], a] = sim >= least
        # the new nodes, a row a query, are appended to the beam
        count = np.bincount(r, minlength=len(active))
        place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        new = np.full((len(active), int(count.max(initial=0))), -np.inf)
        ids = np.zeros(new.shape, np.int64)
        new[r, place], ids[r, place] = sim, a
        nodes, sims = np.concatenate([nodes, ids], axis=1), np.concatenate([sims, new], axis=1)
        spent += width
    return hits


def scan(x: np.ndarray, queries: np.ndarray, least: float) -> np.ndarray:
    """The hits of the queries by comparison with the whole block, themselves left out."""
    out = x[queries] @ x.T >= least
    out[np.arange(len(queries)), queries] = False
    return out


def lead_of(x: np.ndarray, least: float, shard: int = 600) -> np.ndarray:
    """For each vector the id of its lead, itself or a vector within range: the vectors of a shard (those nearest to one centre) are
    led by the first of them that is within range and has no other lead. Near copies so share one node of the graph."""
    lead = np.arange(len(x))
    c = k_means(x, max(1, math.ceil(len(x) / shard)), 4)
    home = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
    order = np.argsort(home, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        for part in range(0, len(members), 4 * shard):
            m = members[part : part + 4 * shard]
            near = x[m] @ x[m].T >= least
            near[np.arange(len(m)), np.arange(len(m))] = False
            free = np.ones(len(m), bool)
            for i in np.flatnonzero(near.any(1)):
                if free[i]:
                    free[i] = False
                    led = near[i] & free
                    lead[m[led]] = m[i]
                    free &= ~led
    return lead


def search_block(x: np.ndarray, queries: np.ndarray, least: float, audit_share: float = AUDIT) -> tuple[list[np.ndarray], int, int]:
    """Hits of each query (ids, itself left out) by the graph search, and the audit: the links that a scan has for the audited share of
    the queries (the first of each thousand), and how many of them the search had found. Where it had missed any, the whole block
    is scanned, so no miss that the audit can see stays in the result.

    The graph's nodes are the leads. Two vectors within range have leads no farther apart than the range and the distances to both
    leads; so the graph is searched for the leads within the range and twice the largest such distance, and the vectors of those that
    are near enough are compared. Links are then what the exact comparison keeps."""
    lead = lead_of(x, least - 1e-9)
    leads, of = np.unique(lead, return_inverse=True)
    chord = np.sqrt(np.maximum(0, ((x - x[lead]) ** 2).sum(1)))
    radius = np.zeros(len(leads))
    np.maximum.at(radius, of, chord)
    by = np.argsort(of, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(leads)))])
    y = x[leads]
    graph, entries = build_graph(y, degree=12, pool=24)
    reach = math.sqrt(2 - 2 * (least - 1e-9))
    wide = 1 - (reach + 2 * radius.max()) ** 2 / 2 - 1e-9
    asked = np.full(len(x), -1)
    asked[queries] = np.arange(len(queries))
    hits: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
    asking = np.unique(of[queries])
    step = max(16, min(256, (1 << 23) // max(len(y), 1)))
    pairs = [np.empty(0, np.int64)]
    for a in range(0, len(asking), step):
        q = asking[a : a + step]
        row, col = np.nonzero(range_search(y, graph, entries, q, wide))
        row = q[row]
        gap = np.sqrt(np.maximum(0, ((y[row] - y[col]) ** 2).sum(1)))
        near = gap <= reach + radius[row] + radius[col] + 1e-9
        pairs.append(row[near] * len(y) + col[near])
    # what one lead's search finds holds for both
    there = np.concatenate(pairs)
    row, col = np.divmod(np.unique(np.concatenate([there, there % len(y) * len(y) + there // len(y)])), len(y))
    ends = np.searchsorted(row, np.arange(len(y) + 1))
    for i in asking:
        near = col[ends[i] : ends[i + 1]]
        if not len(near) or len(near) == 1 and near[0] == i and start[i + 1] - start[i] == 1:
            continue
        ids = np.sort(np.concatenate([by[start[j] : start[j + 1]] for j in near]))
        own = by[start[i] : start[i + 1]]
        own = own[asked[own] >= 0]
        for n, m in zip(own, x[own] @ x[ids].T >= least - 1e-9, strict=True):
            got = ids[m]
            hits[asked[n]] = got[got != n]
    step = max(16, min(256, (1 << 21) // max(len(x), 1)))
    looked = np.flatnonzero(np.arange(len(queries)) % 1000 < audit_share * 1000)
    true = found = 0
    for a in range(0, len(looked), step):
        exact = scan(x, queries[looked[a : a + step]], least - 1e-9)
        true += int(exact.sum())
        found += sum(int(exact[n, hits[k]].sum()) for n, k in enumerate(looked[a : a + step]))
    if found < true:
        hits = [np.flatnonzero(m) for a in range(0, len(queries), step) for m in scan(x, queries[a : a + step], least - 1e-9)]
    return hits, true, found


def near_vectors(vectors: DataFrame, least: float = 0.98, cell: int = CELL, audit_share: float = AUDIT) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_links, audit_found per row of vectors (vec_id, embedding, label).

    Only vectors of one label and one dimension are compared. Equal vectors are one node with a count. Each label is cut into
    cells around centres fitted on at most SAMPLE of its vectors; a vector is searched in its home cell, which also holds every
    vector that may be within range of one there, so no link crosses a border unseen. A cell of more than 4 * cell vectors is
    dealt into blocks and each of its vectors is searched in every block. Links are found by the graph search of a block and verified
    in double precision; a share of the queries is audited by a scan, and a block where the search had missed a link is scanned whole.

    Null, zero or non-finite vectors, null labels and null ids link with nothing: n_links 0, component_id = vec_id, kept.
    audit_links and audit_found say, for the vector's cell, how many links the audit saw and how many the graph search had found.
    Repeated rows count as vectors of their own in n_links. An empty table gives an empty result; other columns are ignored."""
    ship(vectors.sparkSession)
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    plain = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    usable = plain.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(F.coalesce(sound, F.lit(False)))
    usable = usable.withColumn("grp", F.concat(F.col("label").cast("string"), F.lit("/"), F.size("embedding").cast("string")))
    nodes = materialise(usable.groupBy("grp", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors")
    totals = nodes.groupBy("grp").agg(F.count("*").alias("total"))
    id_type = dict(nodes.dtypes)["id"]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(frame["embedding"].to_numpy()).astype(np.float64))
        k = int(min(MAX_CELLS, max(1, math.ceil(frame["total"].iloc[0] / cell))))
        x = x[np.argsort(frame["id"].to_numpy(), kind="stable")]
        return pd.DataFrame({"grp": [frame["grp"].iloc[0]], "centres": [k_means(x, k).ravel().tolist()]})

    sample = nodes.join(totals, "grp").filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(1_000_000.0) * SAMPLE / F.col("total"))
    centres = materialise(sample.groupBy("grp").applyInPandas(fit, f"grp string, centres array<double>"), "centres")

    def deal(frames):  # noqa: ANN001, ANN202
        for f in frames:
            out = []
            for _, g in f.groupby(f["centres"].map(lambda c: hash(c.tobytes())), sort=False):
                x = unit(np.stack(g["embedding"].to_numpy()).astype(np.float64))
                c = g["centres"].iloc[0].reshape(-1, x.shape[1])
                home, also = cells_of(x, c, reach)
                row, at = np.nonzero(also)
                part = g.iloc[row]
                out.append(pd.DataFrame({"grp": part["grp"].to_numpy(), "cell": at, "home": home[row] == at, "id": part["id"].to_numpy(), "copies": part["copies"].to_numpy(), "embedding": part["embedding"].to_numpy()}))
            if out:
                yield pd.concat(out)

    dealt = dealt_cells = materialise(nodes.join(centres, "grp").mapInPandas(deal, f"grp string, cell int, home boolean, id {id_type}, copies long, embedding array<double>"), "cells")
    # a large cell is dealt into blocks: the vectors of a block are searched by all home vectors of the cell, block by block
    sizes = dealt.groupBy("grp", "cell").agg(F.count("*").alias("members"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / (4 * cell)).cast("int"))
    dealt = dealt.join(sizes, ["grp", "cell"]).withColumn("b", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("b")).cast("int"))
    asked = dealt.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).withColumn("x", F.col("own")).filter("home OR y = own").select("grp", "cell", "x", "y", "id", "copies", "embedding", (F.col("home")).alias("asks"), (F.col("own") == F.col("y")).alias("stored"))
    stored = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).withColumn("y", F.col("own")).filter("b > 1 AND x <> own").select("grp", "cell", "x", "y", "id", "copies", "embedding", F.lit(False).alias("asks"), F.lit(True).alias("stored"))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["stored", "id"], ascending=[False, True], kind="stable")
        x = unit(np.stack(frame["embedding"].to_numpy()).astype(np.float64))
        ids, copies = frame["id"].to_numpy(), frame["copies"].to_numpy()
        asks = np.flatnonzero(frame["asks"].to_numpy())
        kept = frame["stored"].to_numpy()
        if not len(asks):
            return pd.DataFrame({"id": ids[:0], "links": [], "low": ids[:0], "audit_links": [], "audit_found": []})
        hits, true, found = search_block(x, asks, least, audit_share)
        root = np.arange(len(ids))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = np.zeros(len(asks), np.int64)
        for k, (i, h) in enumerate(zip(asks, hits, strict=True)):
            if not len(h):
                continue
            h = h[kept[h]]
            h = h[x[h] @ x[i] >= least]
            links[k] = copies[h].sum()
            for j in np.unique(root[h]):
                a, b = top(i), top(j)
                if a != b:
                    a, b = (a, b) if ids[a] < ids[b] else (b, a)
                    root[b] = a
        low = np.array([ids[top(i)] for i in range(len(ids))])
        links_all = np.zeros(len(ids), np.int64)
        links_all[asks] = links
        return pd.DataFrame({"id": ids, "links": links_all, "low": low, "audit_links": true, "audit_found": found})

    answers = asked.unionByName(stored).groupBy("grp", "cell", "x", "y").applyInPandas(block, f"id {id_type}, links long, low {id_type}, audit_links long, audit_found long")
    answers = materialise(answers, "answers")
    groups = connected_components(answers.filter("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v")))
    per_node = answers.groupBy("id").agg(F.sum("links").alias("links"), F.sum("audit_links").alias("audit_links"), F.sum("audit_found").alias("audit_found"))
    per_node = per_node.join(groups, "id", "left").select("id", "links", "audit_links", "audit_found", F.coalesce("component", "id").alias("g"))
    per_node = materialise(per_node, "per_node")
    # back from nodes to vectors, by the vector itself
    of_vector = nodes.join(per_node, "id")
    joined = usable.select("vec_id", "grp", "embedding").distinct().join(of_vector, ["grp", "embedding"])
    per_id = joined.groupBy("vec_id").agg(F.sum(F.col("links") + F.col("copies") - 1).alias("links"), F.min("g").alias("g"), F.sum("audit_links").alias("audit_links"), F.sum("audit_found").alias("audit_found"))
    zero = F.lit(0).cast("long")
    discard(centres, dealt_cells, answers)
    out = plain.select("vec_id").join(per_id, "vec_id", "left").withColumn("component_id", F.coalesce("g", "vec_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    audit = [F.coalesce(c, zero).alias(c) for c in ("audit_links", "audit_found")]
    return out.select("vec_id", F.coalesce("links", zero).alias("n_links"), "component_id", kept, *audit)
