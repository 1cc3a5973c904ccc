"""The best hubs of a corridor per search and category, without the pairs of the whole corridor.

Searches and hubs meet in cogroups of a category and a slice of the searches; a search is shuffled
once per category and no pair is. Inside a group the hubs lie on a grid. The hubs with a detour of
at most m lie in an ellipse around the two ends, so a list is read off a narrow ellipse, and one that is
not full yet takes a wider one, until all hubs are met: lists are exact at any density. Stations and malls
(kind 0) have transit access and come before others, so the others are met only where those do not
fill a list. Hubs that serve both errands come first in every list and are all met.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .. import params
from ..functions import geo

#: Searches a slice of them holds; slices grow with the root of the searches, and so do the copies of the hubs.
SLICE = 100_000
#: Sites that the first ellipse is to hold for each row of the list, and the factor of the next margins.
FIRST, WIDER, ROUNDS = 4, 6.0, 4
#: Pairs measured at once, and searches put on the grid at once.
BLOCK, CHUNK = 400_000, 2_000
FAR = 1e8
KEYS = ("category", "part")
SCHEMA = (
    "sid long, hub_id long, lat double, lon double, two boolean, max_candidates int, kind int, node_m double, has1 boolean, has2 boolean, "
    "coverage int, transit boolean, line_km double, from_o double, to_d double, chord_km double, tag int, sole boolean"
)


# --- tables -------------------------------------------------------------------


def stretches(plans: DataFrame) -> DataFrame:
    """Every stretch of track of every station pair, numbered. The network is a dimension, so one window does it."""
    rows = plans.filter("n_rides IS NOT NULL").select(
        "s", "t", F.explode(F.arrays_zip(
            F.slice("line", F.lit(1), F.size("line") - 1).alias("a"), F.slice("line", F.lit(2), F.size("line") - 1).alias("b")
        )).alias("z"),
    ).select("s", "t", F.col("z.a.lat").alias("a_lat"), F.col("z.a.lon").alias("a_lon"), F.col("z.b.lat").alias("b_lat"), F.col("z.b.lon").alias("b_lon"))
    return rows.withColumn("stretch", F.dense_rank().over(Window.orderBy("a_lat", "a_lon", "b_lat", "b_lon")) - 1)


def near_stretches(stretch_rows: DataFrame, hubs: DataFrame, cells, cell_of) -> DataFrame:
    """The stretches within the corridor of each hub, with their distance."""
    ends = ["a_lat", "a_lon", "b_lat", "b_lon"]
    covered = stretch_rows.select("stretch", *ends).distinct().withColumn("cell", F.explode(cells(*ends)))
    met = covered.join(hubs.select("hub_id", "lat", "lon").withColumn("cell", cell_of("lat", "lon")), "cell")
    near = geo.with_segment_km(met, "km", ("a_lat", "a_lon"), ("b_lat", "b_lon")).filter(F.col("km") <= params.CORRIDOR_KM)
    return near.groupBy("hub_id").agg(F.collect_list("stretch").alias("near_ids"), F.collect_list("km").alias("near_km"))


def lists(expanded: DataFrame, hub_rows: DataFrame, near: DataFrame, stretch_rows: DataFrame, searches: int, cut: bool) -> DataFrame:
    """Best corridor hubs of each list of a search, and all that serve both errands (tag 3).

    ``expanded``: searches by ``category`` with ``sole`` (no other category). With ``cut``, of searches without a
    brand only those hubs are returned that the options kept by ``candidates.prune`` can be made of.
    """
    lines = stretch_rows.groupBy("s", "t").agg(F.collect_set("stretch").alias("line_ids"))
    parts = math.ceil(math.sqrt(max(searches, 1) / SLICE))
    placed = " AND ".join(f"{c} IS NOT NULL" for c in ("o_lat", "o_lon", "d_lat", "d_lon", "base_km"))
    asked = expanded.filter(placed).join(F.broadcast(lines), ["s", "t"], "left").select(
        F.col("category").cast("int").alias("category"), F.pmod(F.xxhash64("sid"), F.lit(parts)).cast("int").alias("part"), "sid",
        F.col("c1").cast("int").alias("c1"), F.coalesce("c2", F.lit(-1)).cast("int").alias("c2"), F.col("max_candidates").cast("int").alias("max_candidates"),
        (F.lit(cut) & F.col("brand1").isNull() & F.col("brand2").isNull()).alias("plain"), "sole",
        "o_lat", "o_lon", "d_lat", "d_lon", "f_lat", "f_lon", "l_lat", "l_lon", "base_km",
        F.when(~F.col("walk_only"), F.col("line_ids")).alias("line_ids"),
    )
    offered = hub_rows.filter("lat IS NOT NULL AND lon IS NOT NULL").join(near, "hub_id", "left").select(
        F.col("category").cast("int").alias("category"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        "hub_id", "lat", "lon", F.col("kind").cast("int").alias("kind"), "node_m", "mask", "near_ids", "near_km",
    )
    return asked.groupBy(*KEYS).cogroup(offered.groupBy(*KEYS)).applyInArrow(_group, SCHEMA)


# --- one group ----------------------------------------------------------------


def _units(lat, lon):
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def _apart(a, b):
    d = a - b
    return 2 * geo.EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) / 2))


def _segment_km(lat, lon, a_lat, a_lon, b_lat, b_lon):
    w = np.cos(np.radians((a_lat + b_lat + lat) / 3)) * geo.KM_PER_LON
    px, py = (lon - a_lon) * w, (lat - a_lat) * geo.KM_PER_LAT
    dx, dy = (b_lon - a_lon) * w, (b_lat - a_lat) * geo.KM_PER_LAT
    n = dx * dx + dy * dy
    t = np.where(n > 0, np.clip((px * dx + py * dy) / np.where(n > 0, n, 1.0), 0.0, 1.0), 0.0)
    return np.hypot(px - t * dx, py - t * dy)


def _runs(counts):
    """0, 1, .. inside each of consecutive runs."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _first(owner, keys, limit):
    """Which rows are among the first ``limit[owner]`` of their owner by ``keys``."""
    order = np.lexsort((*keys[::-1], owner))
    sorted_owner = owner[order]
    new = np.r_[True, sorted_owner[1:] != sorted_owner[:-1]] if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    kept = np.zeros(len(order), bool)
    kept[order] = np.arange(len(order)) - start < limit[sorted_owner]
    return kept


class _Sites:
    """Some hubs of a group on a grid, so that neighbouring cells of a row are one slice."""

    def __init__(self, at, y, x):
        self.n = len(at)
        if not self.n:
            return
        self.y0, self.x0 = y.min(), x.min()
        tall, wide = y.max() - self.y0, x.max() - self.x0
        self.area = max(tall, 0.1) * max(wide, 0.1)
        self.size = max(math.sqrt(tall * wide * 3 / self.n), max(tall, wide) * 3 / self.n, 1e-3)
        row, col = ((y - self.y0) / self.size).astype(np.int64), ((x - self.x0) / self.size).astype(np.int64)
        self.rows, self.cols = int(row.max()) + 1, int(col.max()) + 1
        cell = row * self.cols + col
        order = np.argsort(cell, kind="stable")
        self.at = at[order]
        self.off = np.searchsorted(cell[order], np.arange(self.rows * self.cols + 1))

    def around(self, oy, ox, dy, dx, reach):
        """Blocks of (search, hub) indexes whose hubs may lie on a way of at most ``reach`` between the ends."""
        a = reach / 2 + 1e-6
        half = np.hypot(dy - oy, dx - ox) / 2
        narrow = np.maximum(a * a - half * half, 1e-6)
        some = half > 1e-9
        uy, ux = np.where(some, (dy - oy) / np.where(some, 2 * half, 1), 0.0), np.where(some, (dx - ox) / np.where(some, 2 * half, 1), 1.0)
        syy, sxy = a * a * uy * uy + narrow * ux * ux, (a * a - narrow) * uy * ux
        tall, wide, slope = np.sqrt(syy), a * np.sqrt(narrow / syy), sxy / syy
        cy, cx = (oy + dy) / 2, (ox + dx) / 2
        to_row = lambda v: np.floor((v - self.y0) / self.size).astype(np.int64)
        low, high = np.maximum(to_row(cy - tall), 0), np.minimum(to_row(cy + tall), self.rows - 1)
        counts = np.maximum(high - low + 1, 0)
        search = np.repeat(np.arange(len(a)), counts)
        row = low[search] + _runs(counts)
        south = self.y0 + row * self.size - cy[search]
        t = tall[search]
        at_low, at_high = slope[search] * np.clip(south, -t, t), slope[search] * np.clip(south + self.size, -t, t)
        west, east = np.minimum(at_low, at_high) - wide[search] + cx[search], np.maximum(at_low, at_high) + wide[search] + cx[search]
        first = np.clip(np.floor((west - self.x0) / self.size).astype(np.int64), 0, self.cols)
        last = np.clip(np.floor((east - self.x0) / self.size).astype(np.int64) + 1, first, self.cols)
        start, stop = self.off[row * self.cols + first], self.off[row * self.cols + last]
        many = stop - start
        upto = np.cumsum(many)
        at = 0
        while at < len(many):
            end = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK)), at + 1)
            n = many[at:end]
            yield np.repeat(search[at:end], n), self.at[np.repeat(start[at:end], n) + _runs(n)]
            at = end


class _Group:
    """Searches of one category and the hubs that serve it."""

    def __init__(self, searches: pa.Table, hubs: pa.Table):
        col = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
        self.s = {c: col(searches, c) for c in searches.column_names if c != "line_ids"}
        self.h = {c: col(hubs, c) for c in hubs.column_names if c not in ("near_ids", "near_km")}
        self.n_s, self.n_h = searches.num_rows, hubs.num_rows
        self.category = int(self.s["category"][0])
        self.h["node_m"] = self.h["node_m"].astype(float)
        self.h["node"] = np.where(np.isnan(self.h["node_m"]), 99999.0, self.h["node_m"])
        self.o, self.d = _units(self.s["o_lat"], self.s["o_lon"]), _units(self.s["d_lat"], self.s["d_lon"])
        self.u = _units(self.h["lat"], self.h["lon"])
        self._rail(searches.column("line_ids").combine_chunks(), hubs.column("near_ids").combine_chunks(), hubs.column("near_km").combine_chunks())
        # A plane whose distances are never longer than the true ones, so no hub falls out of an ellipse.
        lats = np.concatenate([self.s["o_lat"], self.s["d_lat"], self.h["lat"]])
        lons = np.concatenate([self.s["o_lon"], self.s["d_lon"], self.h["lon"]])
        self.flat = np.ptp(lats) < 3 and np.ptp(lons) < 3 and np.abs(lats).max() < 80
        shrunk = 0.9995 * math.radians(1) * geo.EARTH_KM
        per_lon = shrunk * math.cos(math.radians(np.abs(lats).max()))
        self.plane = lambda lat, lon: (lat * shrunk, lon * per_lon)
        self.oy, self.ox = self.plane(self.s["o_lat"], self.s["o_lon"])
        self.dy, self.dx = self.plane(self.s["d_lat"], self.s["d_lon"])
        self.hy, self.hx = self.plane(self.h["lat"], self.h["lon"])

    def _rail(self, lines, ids, kms):
        """Distances of hubs to stretches, and the stretches of each search's line, as tables with a blank last column."""
        counts = np.asarray(pc.fill_null(pc.list_value_length(lines), 0))
        used = np.asarray(lines.flatten())
        near = np.asarray(pc.fill_null(pc.list_value_length(ids), 0))
        met = np.asarray(ids.flatten())
        blank = int(max(used.max(initial=-1), met.max(initial=-1))) + 1
        self.km = np.full((self.n_h, blank + 1), np.inf)
        if len(met):
            self.km[np.repeat(np.arange(self.n_h), near), met.astype(np.int64)] = np.asarray(kms.flatten())
        self.line = np.full((self.n_s, int(counts.max(initial=0))), blank, np.int64)
        if len(used):
            self.line[np.repeat(np.arange(self.n_s), counts), _runs(counts)] = used

    def sites(self, chosen):
        at = np.flatnonzero(chosen)
        return _Sites(at, self.hy[at], self.hx[at])

    def measure(self, si, hi, margin):
        """Rows of the pairs inside the corridor with a detour of at most ``margin``."""
        s, h = self.s, self.h
        u = self.u[hi]
        from_o, to_d = _apart(self.o[si], u), _apart(u, self.d[si])
        chord = np.maximum(0.0, from_o + to_d - s["base_km"][si])
        keep = chord <= margin[si]
        si, hi, from_o, to_d, chord = si[keep], hi[keep], from_o[keep], to_d[keep], chord[keep]
        lat, lon = h["lat"][hi], h["lon"][hi]
        line = np.minimum(
            _segment_km(lat, lon, s["o_lat"][si], s["o_lon"][si], s["f_lat"][si], s["f_lon"][si]),
            _segment_km(lat, lon, s["l_lat"][si], s["l_lon"][si], s["d_lat"][si], s["d_lon"][si]),
        )
        for j in range(self.line.shape[1]):
            line = np.minimum(line, self.km[hi, self.line[si, j]])
        end = np.minimum(from_o, to_d)
        keep = (line <= params.CORRIDOR_KM) | (end <= params.ENDPOINT_KM)
        transit = (h["kind"][hi] == 0) | (h["node_m"][hi] <= params.TRANSIT_M) | (end <= params.ENDPOINT_KM)
        return {"si": si[keep], "hi": hi[keep], "from_o": from_o[keep], "to_d": to_d[keep], "chord_km": chord[keep], "line_km": line[keep], "transit": transit[keep]}

    def keys(self, r):
        return [r["chord_km"], self.h["node"][r["hi"]], self.h["hub_id"][r["hi"]]]

    def meet(self, sites, wanted, need, barred=None):
        """The first ``need`` rows of the ``wanted`` searches by transit, then detour; all where it is None.

        ``barred``: a mask per search; hubs that serve any of it are left out.
        """
        parts = []
        if not sites.n:
            return _join(parts)
        base = self.s["base_km"]
        for at in range(0, len(wanted), CHUNK):
            left = wanted[at : at + CHUNK]
            margin = np.full(self.n_s, FAR)
            if need is not None and self.flat:
                target = FIRST * need[left] * sites.area / sites.n / (math.pi / 4)
                m = np.full(len(left), 0.5)
                for _ in range(6):
                    across = target / (base[left] + m)
                    m = np.sqrt(base[left] * base[left] + across * across) - base[left]
                margin[left] = np.maximum(m, 1e-3)
            for turn in range(ROUNDS + 1):
                if turn == ROUNDS:
                    margin[left] = FAR
                found = []
                reach = np.minimum(base[left] + margin[left], FAR)
                for si, hi in sites.around(self.oy[left], self.ox[left], self.dy[left], self.dx[left], reach):
                    si = left[si]
                    if barred is not None:
                        free = (self.h["mask"][hi] & barred[si]) == 0
                        si, hi = si[free], hi[free]
                    rows = self.measure(si, hi, margin)
                    if need is not None:
                        rows = _take(rows, _first(rows["si"], [~rows["transit"], *self.keys(rows)], need))
                    found.append(rows)
                rows = _join(found)
                if need is None:
                    parts.append(rows)
                    break
                rows = _take(rows, _first(rows["si"], [~rows["transit"], *self.keys(rows)], need))
                full = np.bincount(rows["si"][rows["transit"]], minlength=self.n_s)[left] >= need[left]
                done = full | (margin[left] >= FAR)
                closed = np.zeros(self.n_s, bool)
                closed[left[done]] = True
                parts.append(_take(rows, closed[rows["si"]]))
                left = left[~done]
                if not len(left):
                    break
                margin[left] = margin[left] * WIDER
        return _join(parts)

    def count(self, rows, chosen=None):
        return np.bincount(rows["si"] if chosen is None else rows["si"][chosen], minlength=self.n_s)

    def listed(self, tag):
        """Rows of one list of the searches that have it, and the rows that serve both errands."""
        s, h, c = self.s, self.h, self.category
        own, other = (s["c1"], s["c2"]) if tag == 1 else (s["c2"], s["c1"])
        wanted = np.flatnonzero(own == c)
        two = s["c2"] >= 0
        limit = np.where(two, params.HUBS_PER_CATEGORY, np.maximum(3 * s["max_candidates"], params.HUBS_PER_CATEGORY))
        paired = two & (other != c)
        barred = np.where(paired, np.left_shift(np.int64(1), np.maximum(other, 0).astype(np.int64)), np.int64(0))
        whole = []
        for o in np.unique(other[wanted][paired[wanted]]):
            both = self.sites((h["mask"] >> np.int64(o)) & 1 == 1)
            whole.append(self.meet(both, wanted[paired[wanted] & (other[wanted] == o)], None))
        whole = _join(whole)
        parts = []
        need = limit - self.count(whole, whole["transit"])
        for kind in (0, 1):
            still = wanted[need[wanted] > 0]
            rows = self.meet(self.sites(h["kind"] == kind), still, need, barred)
            parts.append(rows)
            need = need - self.count(rows, rows["transit"])
        rows = _join(parts)
        # Without transit, hubs that serve both come before those that serve one.
        room = limit - self.count(whole)
        short = np.where(self.count(rows, rows["transit"]) + self.count(whole, whole["transit"]) > 0, limit - self.count(whole, whole["transit"]), room)
        rank = [~rows["transit"], h["kind"][rows["hi"]], *self.keys(rows)]
        rows = _take(rows, _first(rows["si"], rank, np.maximum(short, 0)))
        # Transit access decides among all hubs of a search, which only the group of its sole category sees.
        settled = s["sole"] & (self.count(rows, rows["transit"]) + self.count(whole, whole["transit"]) > 0)
        return tuple(_take(r, r["transit"] | ~settled[r["si"]]) for r in (rows, whole))

    def cheap(self, rows, lone):
        """Rows that can be part of a kept option: the least in cost, with and without the detour cap, and the nearest to each end.

        ``lone`` rows serve the request alone and also enter pairs. Hubs without transit go if a list has any with it.
        """
        plain = self.s["plain"][rows["si"]]
        with_transit = self.count(rows, rows["transit"]) > 0
        alive = rows["transit"] | ~with_transit[rows["si"]]
        cost = np.floor((2 * rows["line_km"] + np.nan_to_num(self.h["node_m"][rows["hi"]]) / 1000) * 1000 + 0.5 + 1e-9)
        order = [~alive, cost, rows["chord_km"], self.h["hub_id"][rows["hi"]]]
        most = np.full(self.n_s, params.MAX_CANDIDATES) if lone else self.s["max_candidates"]
        over = ~(alive & (rows["chord_km"] <= params.CHORD_CAP_KM))
        kept = _first(rows["si"], [over, *order], most)
        one = np.ones(self.n_s, np.int64)
        for reach in ("from_o", "to_d"):
            kept |= _first(rows["si"], [over, ~alive, rows[reach], self.h["hub_id"][rows["hi"]]], one)
        if lone:
            kept |= _first(rows["si"], order, most)
        return _take(rows, kept | ~plain)

    def out(self, rows, tag):
        s, h, si, hi = self.s, self.h, rows["si"], rows["hi"]
        c1, c2 = s["c1"][si].astype(np.int64), s["c2"][si].astype(np.int64)
        two = c2 >= 0
        has1 = (h["mask"][hi] >> c1) & 1 == 1
        has2 = two & ((h["mask"][hi] >> np.maximum(c2, 0)) & 1 == 1)
        coverage = has1.astype(np.int32) + np.where(two & (c1 != c2), has2, False)
        node = h["node_m"][hi]
        return pa.table({
            "sid": s["sid"][si], "hub_id": h["hub_id"][hi], "lat": h["lat"][hi], "lon": h["lon"][hi], "two": two, "max_candidates": s["max_candidates"][si].astype(np.int32),
            "kind": h["kind"][hi].astype(np.int32), "node_m": pa.array(node, mask=np.isnan(node)), "has1": has1, "has2": has2, "coverage": coverage.astype(np.int32),
            "transit": rows["transit"], "line_km": rows["line_km"], "from_o": rows["from_o"], "to_d": rows["to_d"], "chord_km": rows["chord_km"],
            "tag": np.full(len(si), tag, np.int32), "sole": s["sole"][si].astype(bool),
        })


FIELDS = {"si": np.int64, "hi": np.int64, "from_o": float, "to_d": float, "chord_km": float, "line_km": float, "transit": bool}


def _join(parts):
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, t) for c, t in FIELDS.items()}


def _take(rows, mask):
    return {c: v[mask] for c, v in rows.items()}


def _group(searches: pa.Table, hubs: pa.Table) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in SCHEMA.split(","))])
    if not searches.num_rows or not hubs.num_rows:
        return schema.empty_table()
    g = _Group(searches, hubs)
    s, c = g.s, g.category
    tables = []
    for tag in (1, 2):
        rows, whole = g.listed(tag)
        single = s["c2"][rows["si"]] < 0
        kept = g.cheap(_take(rows, single), False) if tag == 1 else _take(rows, single)
        tables += [g.out(kept, tag), g.out(_take(rows, ~single), tag)]
        if tag == 1:
            tables.append(g.out(g.cheap(whole, True), 3))
    # A category below the one asked for: only whether it has a hub in the corridor, and one with transit.
    below = np.flatnonzero((s["c1"] != c) & (s["c2"] != c))
    one = np.zeros(g.n_s, np.int64)
    one[below] = 1
    for kind in (0, 1):
        rows = g.meet(g.sites(g.h["kind"] == kind), below[one[below] > 0], one)
        one = one - g.count(rows, rows["transit"])
        tables.append(g.out(rows, 0))
    return pa.concat_tables([t.cast(schema) for t in tables])
