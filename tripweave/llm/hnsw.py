"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label collapse into a class with a weight first, so a crowd of copies is one
point. The classes of a label are dealt into shards of bounded size; each shard builds a graph,
and the classes of every shard up to it are looked up there, so each pair of shards meets once.
Inside a task many lookups advance together as array operations.

A lookup keeps a beam of the most similar points met. A beam full of links may have missed some,
so from there it goes on without a bound, over all links and near links it can reach; and a fixed
part of the lookups, larger where links are few, is audited against a full comparison, widening
all beams of the shard until the recall of links between different points is reached.
Candidates are verified by the cosine in double precision. Links leave a task as counts per
class and as a spanning forest, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fanout, field, gather, store
from .components import components
from .simhash import _hook

THRESHOLD = 0.98

#: Classes in a shard at most on average; with its graph a shard takes some 100 MB at 64 dimensions.
SHARD_ROWS = 65_536

#: Links of a point in the base layer, half of them above; beams while building and looking up.
DEGREE, BUILD_BEAM, BEAM = 24, 40, 48

#: One lookup in so many is audited, and more until they have so many links; a shard's beams widen
#: until this recall is reached.
AUDIT_EVERY, AUDIT_LINKS, RECALL = 50, 200, 0.995


class Graph:
    """A small-world graph over unit vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.x = vectors.astype(np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(DEGREE / 2)).astype(np.int64), 8)
        order = np.argsort(-levels, kind="stable")  # upper layers first, so they guide the lower ones
        top = int(levels[order[0]]) if n else 0
        self.layers = [np.full((n, DEGREE if layer == 0 else DEGREE // 2), -1, dtype=np.int32) for layer in range(top + 1)]
        self.entry = int(order[0]) if n else -1
        done = 0
        while done < n:
            size = max(64, min(1024, done // 4))
            chunk = order[done : done + size]
            self._insert(chunk, levels, done == 0)
            done += len(chunk)
        if n:
            self._reach()

    def _reach(self) -> None:
        """Give every point a way in: pruning may have cut all links that lead to it."""
        links = self.layers[0]
        while True:
            seen = np.zeros(len(links), dtype=bool)
            seen[self.entry] = True
            front = np.array([self.entry])
            while len(front):
                near = np.unique(links[front])
                front = near[(near >= 0) & ~seen[np.maximum(near, 0)]]
                seen[front] = True
            lost = np.flatnonzero(~seen)
            if not len(lost):
                break
            out = links[lost]
            fit = (out >= 0) & seen[np.maximum(out, 0)]
            source = np.where(fit.any(axis=1), out[np.arange(len(lost)), fit.argmax(axis=1)], -1)
            if (source < 0).all():
                source[0] = self.entry
            lost, source = lost[source >= 0], source[source >= 0]
            order = np.argsort(source, kind="stable")
            lost, source = lost[order], source[order]
            place = np.arange(len(source)) - np.searchsorted(source, source)
            extra = np.full((len(links), min(int(place.max()) + 1, 8)), -1, dtype=links.dtype)
            fits = place < extra.shape[1]
            extra[source[fits], place[fits]] = lost[fits]
            links = np.concatenate([links, extra], axis=1)
        self.layers[0] = links
        # all links in both directions, point after point
        row, column = np.nonzero(links >= 0)
        target, n = links[row, column].astype(np.int64), len(links)
        code = np.unique(np.concatenate([row * n + target, target * n + row]))
        self.around, self.begin = code % n, np.searchsorted(code, np.arange(n + 1) * n)

    def _insert(self, chunk: np.ndarray, levels: np.ndarray, first: bool) -> None:
        start = np.full((len(chunk), 1), self.entry, dtype=np.int64)
        mutual = self.x[chunk] @ self.x[chunk].T
        for layer in range(len(self.layers) - 1, -1, -1):
            here = np.flatnonzero(levels[chunk] >= layer)
            width = BUILD_BEAM if len(here) else 1
            if first:
                ids, sims = np.full((len(chunk), 1), -1), np.full((len(chunk), 1), -2.0, dtype=np.float32)
            else:
                ids, sims = self.search(self.x[chunk], start, width, layer)
                start = np.where(ids[:, :1] >= 0, ids[:, :1], start)
            if not len(here):
                continue
            # neighbours come from the graph and from the chunk itself
            near = mutual[np.ix_(here, here)].copy()
            np.fill_diagonal(near, -2.0)
            k = min(BUILD_BEAM // 2, len(here))
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            cand = np.concatenate([ids[here], chunk[here][best]], axis=1)
            score = np.concatenate([sims[here], np.take_along_axis(near, best, axis=1)], axis=1)
            cand = np.where(score > -1.5, cand, -1)
            chosen = self._diverse(cand, score, self.layers[layer].shape[1])
            self.layers[layer][chunk[here]] = chosen
            self._back(layer, chunk[here], chosen)

    def _diverse(self, cand: np.ndarray, score: np.ndarray, degree: int) -> np.ndarray:
        """Up to ``degree`` candidates per row, each nearer to the row's point than to those chosen
        before; places left over go to the nearest of the others."""
        order = np.argsort(-score, axis=1, kind="stable")
        cand, score = np.take_along_axis(cand, order, axis=1), np.take_along_axis(score, order, axis=1)
        out = np.full((len(cand), degree), -1, dtype=np.int32)
        for at in range(0, len(cand), 512):
            c, s = cand[at : at + 512], score[at : at + 512]
            v = self.x[np.maximum(c, 0)]
            pair = v @ v.transpose(0, 2, 1)
            kept = np.zeros(c.shape, dtype=bool)
            count = np.zeros(len(c), dtype=np.int64)
            for j in range(c.shape[1]):
                blocked = ((pair[:, j, :] >= s[:, j, None]) & kept).any(axis=1)
                take = (c[:, j] >= 0) & ~blocked & (count < degree // 2)
                kept[:, j] = take
                count += take
            rank = np.argsort(np.where(c < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :degree]
            out[at : at + 512, : rank.shape[1]] = np.take_along_axis(c, rank, axis=1)
        return out

    def _back(self, layer: int, points: np.ndarray, chosen: np.ndarray) -> None:
        """Links the other way round; a point with too many chooses anew."""
        links = self.layers[layer]
        degree = links.shape[1]
        source = np.repeat(points, chosen.shape[1])
        target = chosen.ravel().astype(np.int64)
        good = target >= 0
        source, target = source[good], target[good]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, begin, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(heads), degree + min(int(count.max()) if len(count) else 0, 4 * degree)), -1, dtype=np.int64)
        wide[:, :degree] = links[heads]
        place = np.arange(len(target)) - np.repeat(begin, count)
        row = np.repeat(np.arange(len(heads)), count)
        fits = place < wide.shape[1] - degree
        wide[row[fits], degree + place[fits]] = source[fits]
        wide.sort(axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        for at in range(0, len(heads), 2048):
            w, h = wide[at : at + 2048], heads[at : at + 2048]
            score = np.einsum("nd,nkd->nk", self.x[h], self.x[np.maximum(w, 0)])
            score[w < 0] = -2.0
            links[h] = self._diverse(w, score, degree)

    def search(self, queries: np.ndarray, start: np.ndarray, beam: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query in one layer, most similar first: ids (-1: none) and similarities."""
        n, step = len(self.x), max(1, min(1024, (1 << 25) // max(len(self.x), 1)))
        if len(queries) > step:
            parts = [self.search(queries[i : i + step], start[i : i + step], beam, layer) for i in range(0, len(queries), step)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        links, q = self.layers[layer], len(queries)
        seen = np.zeros((q, n), dtype=bool)
        ids = np.full((q, beam), -1, dtype=np.int64)
        sims = np.full((q, beam), -2.0, dtype=np.float32)
        open_ = np.zeros((q, beam), dtype=bool)
        width = min(start.shape[1], beam)
        first = start[:, :width]
        ids[:, :width] = first
        sims[:, :width] = np.einsum("qd,qkd->qk", queries, self.x[np.maximum(first, 0)])
        sims[:, :width][first < 0] = -2.0
        rows = np.arange(q)[:, None]
        seen[rows, np.maximum(first, 0)] = True
        open_[:, :width] = first >= 0
        if width > 1:  # a start given twice counts once
            twice = (first[:, 1:] == first[:, :1]) & (first[:, 1:] >= 0)
            ids[:, 1:width][twice], open_[:, 1:width][twice] = -1, False
            sims[:, 1:width][twice] = -2.0
        live = np.arange(q)
        while len(live):
            score = np.where(open_[live], sims[live], -3.0)
            take = min(4, beam)
            pick = np.argpartition(-score, take - 1, axis=1)[:, :take] if beam > take else np.tile(np.arange(beam), (len(live), 1))
            usable = np.take_along_axis(score, pick, axis=1) > -3.0
            going = usable.any(axis=1)
            live, pick, usable = live[going], pick[going], usable[going]
            if not len(live):
                break
            open_[live[:, None], pick] = False
            hubs = np.where(usable, ids[live[:, None], pick], -1)
            near = np.where((hubs >= 0)[:, :, None], links[np.maximum(hubs, 0)], -1).reshape(len(live), -1).astype(np.int64)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            old = seen[live[:, None], np.maximum(near, 0)]
            near[old] = -1
            at, column = np.nonzero(near >= 0)
            seen[live[at], near[at, column]] = True
            found = np.full(near.shape, -2.0, dtype=np.float32)
            found[at, column] = np.einsum("nd,nd->n", queries[live[at]], self.x[near[at, column]])
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sims = np.concatenate([sims[live], found], axis=1)
            all_open = np.concatenate([open_[live], near >= 0], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_ids, best, axis=1)
            sims[live] = np.take_along_axis(all_sims, best, axis=1)
            open_[live] = np.take_along_axis(all_open, best, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """Where the base layer is entered: the nearest point on the way down."""
        start = np.full((len(queries), 1), self.entry, dtype=np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self.search(queries, start, 1, layer)[0]
        return start


def lookup(graph: Graph, exact: np.ndarray, queries: np.ndarray, own: np.ndarray | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, int]:
    """Verified links (query row, graph row) and the beam that passed the audit.

    ``exact`` and ``queries`` are unit vectors in double precision; ``own``, the queries' places in
    the graph, is given where the queries are the graph's points, in their order.
    """
    q = queries.astype(np.float32)
    start = graph.entries(q)
    if own is not None:
        start = np.concatenate([own[:, None], start], axis=1)
    loose = threshold - 1e-4
    beam = min(BEAM, len(exact))
    truth = None
    while True:
        rows, hits = _links(graph, q, start, beam, loose)
        cosine = np.einsum("nd,nd->n", queries[rows], exact[hits])
        good = cosine >= threshold
        rows, hits = rows[good], hits[good]
        if own is not None:  # a pair found from either end is found
            code = np.unique(np.concatenate([rows * len(exact) + hits, hits * len(exact) + rows]))
            rows, hits = code // len(exact), code % len(exact)
        if beam >= len(exact):
            break
        if truth is None:
            audited, truth, known = _audit(exact, queries, own is not None, threshold)
            if known is not None:
                rows, hits = known
                break
        real = rows != hits if own is not None else np.ones(len(rows), dtype=bool)
        if audited[rows[real]].sum() >= RECALL * truth:
            break
        beam = min(2 * beam, len(exact))
    return rows, hits, beam


def _audit(exact: np.ndarray, queries: np.ndarray, own: bool, threshold: float) -> tuple[np.ndarray, int, tuple[np.ndarray, np.ndarray] | None]:
    """Which lookups are compared in full, and how many links they have; a point's match with itself is none.

    Lookups are added until they have ``AUDIT_LINKS`` links. Where all of them have fewer, the
    links of all are known and returned (in a shard of its own, with every point's own).
    """
    order = np.argsort(np.arange(len(queries)) % AUDIT_EVERY, kind="stable")
    audited = np.zeros(len(queries), dtype=bool)
    size, done, truth = -(-len(queries) // AUDIT_EVERY), 0, 0
    rows, hits = [np.arange(len(queries) if own else 0)], [np.arange(len(queries) if own else 0)]
    while done < len(queries) and (done < size or truth < AUDIT_LINKS):
        part = order[done : done + 256] if done >= size else order[done : min(done + 256, size)]
        match = queries[part] @ exact.T >= threshold
        if own:
            match[np.arange(len(part)), part] = False
        count = int(match.sum())
        truth += count
        if truth < AUDIT_LINKS and count:
            r, c = np.nonzero(match)
            rows.append(part[r])
            hits.append(c)
        audited[part] = True
        done += len(part)
    if done < len(queries) or truth >= AUDIT_LINKS:
        return audited, truth, None
    return audited, truth, (np.concatenate(rows), np.concatenate(hits))


def _links(graph: Graph, q: np.ndarray, start: np.ndarray, beam: int, loose: float) -> tuple[np.ndarray, np.ndarray]:
    """Query and graph rows of all links met by beams of this width, or by ones as wide as the
    links themselves where a beam was full of them."""
    rows, hits = [], []
    for at in range(0, len(q), 1 << 14):
        ids, sims = graph.search(q[at : at + (1 << 14)], start[at : at + (1 << 14)], beam)
        full = (sims[:, -1] >= loose) & (beam < len(graph.x))
        r, c = np.nonzero((sims >= loose) & ~full[:, None])
        rows.append(at + r)
        hits.append(ids[r, c])
        crowded = np.flatnonzero(full)
        for i in range(0, len(crowded), 128):
            part = crowded[i : i + 128]
            r, found = _flood(graph, q[at + part], ids[part], loose)
            rows.append(at + part[r])
            hits.append(found)
    return np.concatenate(rows), np.concatenate(hits)


def _flood(graph: Graph, q: np.ndarray, seeds: np.ndarray, loose: float, margin: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """All points from which links (or near ones) lead back to the seeds: a beam without an end."""
    seen = np.zeros((len(q), len(graph.x)), dtype=bool)
    row, node = np.repeat(np.arange(len(q)), seeds.shape[1]), seeds.ravel()
    seen[row, node] = True
    rows, hits = [row], [node]
    while len(row):
        fresh_rows, fresh = [], []
        for at in range(0, len(row), 1 << 15):
            points = node[at : at + (1 << 15)]
            count = graph.begin[points + 1] - graph.begin[points]
            near = gather(graph.around, graph.begin[points], count)
            r = np.repeat(row[at : at + (1 << 15)], count)
            new = np.flatnonzero(~seen[r, near])
            code = np.unique(r[new] * len(graph.x) + near[new])
            r, near = code // len(graph.x), code % len(graph.x)
            seen[r, near] = True
            good = np.einsum("nd,nd->n", q[r], graph.x[near]) >= loose - margin
            fresh_rows.append(r[good])
            fresh.append(near[good])
        row, node = np.concatenate(fresh_rows), np.concatenate(fresh)
        rows.append(row)
        hits.append(node)
    row, node = np.concatenate(rows), np.concatenate(hits)
    good = np.einsum("nd,nd->n", q[row], graph.x[node]) >= loose
    return row[good], node[good]


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class _Unit:
    """One shard's graph and what the lookups in it have found."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.graph = None
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, member: bool) -> Iterator[pa.RecordBatch]:
        if member:
            self.parts.append((ids, weights, vectors))
            return
        yield from self.build()
        yield self.found(ids, weights, _unit(vectors), None)

    def build(self) -> Iterator[pa.RecordBatch]:
        if self.graph is None and self.parts:
            self.ids, self.weights, vectors = (np.concatenate(x) for x in zip(*self.parts))
            self.parts = []
            self.exact = _unit(vectors)
            self.graph = Graph(self.exact)
            yield self.found(self.ids, self.weights, self.exact, np.arange(len(self.ids)))

    def found(self, ids: np.ndarray, weights: np.ndarray, queries: np.ndarray, own: np.ndarray | None) -> pa.RecordBatch:
        rows, hits, _ = lookup(self.graph, self.exact, queries, own, self.threshold)
        m = len(self.ids)
        if own is not None:  # both directions of a pair count once
            apart = rows != hits
            code = np.unique(np.minimum(rows, hits)[apart] * m + np.maximum(rows, hits)[apart])
            rows, hits = code // m, code % m
            links = np.bincount(rows, self.weights[hits], m) + np.bincount(hits, self.weights[rows], m)
            parent = _hook(np.arange(m), rows, hits)
            child = np.flatnonzero((parent != np.arange(m)) | (links > 0))
            return _batch(ids[child], links[child], ids[parent[child]])
        # a query's links, and the graph points linked to it
        mine = np.bincount(rows, self.weights[hits], len(ids))
        theirs = np.bincount(hits, weights[rows], m)
        parent = _hook(np.arange(len(ids) + m), rows, len(ids) + hits)
        every = np.concatenate([ids, self.ids])
        links = np.concatenate([mine, theirs])
        child = np.flatnonzero(links > 0)
        return _batch(every[child], links[child], every[parent[child]])


def _batch(ids: np.ndarray, links: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(links.astype(np.int64)), pa.array(roots.astype(np.int64))], ["cid", "links", "root"])


def _run(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit = None, _Unit(threshold)
        for batch in batches:
            units, queries, cids, weights = (np.asarray(batch.column(i)) for i in range(4))
            vectors = batch.column(4)
            cuts = [0, *(np.flatnonzero((units[1:] != units[:-1]) | (queries[1:] != queries[:-1])) + 1).tolist(), len(units)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if units[a] != key:
                    yield from unit.build()
                    key, unit = units[a], _Unit(threshold)
                flat = np.asarray(vectors.slice(a, b - a).flatten(), dtype=np.float64).reshape(b - a, -1)
                yield from unit.add(cids[a:b], weights[a:b], flat, not queries[a])
        yield from unit.build()

    return run


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Only vectors of equal label and equal length are compared. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows without a label, link with nothing;
    their component is their own id. ``kept`` says whether a row's id is the smallest reachable.
    Repeated rows are vectors of their own and link with each other. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    given = rows.select(field(vec_id).cast("long").alias("vec_id"), field(label).cast("string").alias("label"), field(vector).cast("array<double>").alias("v"))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    given = store(given.withColumn("key", F.when(usable, F.col("v"))).select("vec_id", "label", "key"), "vectors")
    classes = given.where("key IS NOT NULL").groupBy("label", "key").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    classes = store(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    shards = classes.groupBy("label", F.size("key").alias("dim")).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    # the units get numbers, so that a task tells them apart by one
    shards = store(shards.withColumn("group", F.monotonically_increasing_id()), "shards")
    placed = classes.withColumn("dim", F.size("key")).join(shards, ["label", "dim"]).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("shards").cast("long")).cast("int"))
    meet = placed.select("group", "mine", "cid", "weight", "key", F.explode(F.sequence("mine", F.col("shards") - 1)).alias("other"))
    units = meet.select(F.xxhash64("group", "other").alias("unit"), (F.col("other") != F.col("mine")).cast("int").alias("query"), "cid", "weight", "key")
    ready = units.repartition(fanout(spark), "unit").sortWithinPartitions("unit", "query")
    found = store(ready.mapInArrow(_run(threshold), "cid long, links long, root long"), "found")
    roots = components(found, "cid", "root")
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component"))
    known = joined.join(smallest, "root").join(counted, "cid", "left").select("label", "key", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"))
    out = given.join(known, ["label", "key"], "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
