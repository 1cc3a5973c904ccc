"""Merkle manifest of a table: a postorder log of digests, and proofs addressed inside it.

Leaves of a tree stand in key order and are cut into aligned blocks of 2**12, so a block is a whole
subtree and is built without its neighbours. A builder appends every node to the block's log
in the order of completion: both children before their parent. The roots of the blocks are
the leaves of the next tier, built alike, until a tree is one block.

The log needs no index. A node of level l over leaves up to i completes right after them, so it
stands at ``2 i - popcount(i) + l``: what comes before are the leaves 0 to i - 1 with all full
subtrees they close, and the l lower nodes that close with leaf i. On the ragged right edge,
nodes that are not full complete last, from the bottom up. Proofs are read from the logs by
these positions, top tier first; a block gets the path above it and hands it on.

Numbering the leaves takes one range partitioning by key; its partitions hold narrow rows, and
rows alike in everything are told apart by their place, so no key is too large for a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fanout, field, packed, store

#: Levels of a block, and digests' bytes.
HEIGHT, WIDTH = 12, 32


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    return max(0, (n - 1).bit_length())


def position(i: int, level: int, n: int) -> int:
    """Where the log of n leaves holds the node of ``level`` over leaf ``i``."""
    last = ((i >> level) + 1 << level) - 1
    if last < n:
        return 2 * last - last.bit_count() + level
    ragged = sum(1 for l in range(1, level) if n & ((1 << l) - 1))
    return 2 * n - n.bit_count() + ragged


def siblings(i: int, n: int, levels: int) -> Iterator[tuple[int, int]]:
    """``(position, side)`` of the sibling at each level that has one; side 1 stands on the left."""
    for level in range(levels):
        node = i >> level
        if node & 1:
            yield position(node - 1 << level, level, n), 1
        elif (node + 1) << level < n:
            yield position(node + 1 << level, level, n), 0
        else:
            yield -1, 0


class Builder:
    """The log of one block: nodes in the order of completion."""

    def __init__(self) -> None:
        self.log: list[str] = []
        self.n = 0
        self.open: list[str] = []  # roots of full subtrees, large ones first

    def add(self, leaf: str) -> None:
        self.log.append(leaf)
        carried, filled = leaf, self.n
        while filled & 1:
            carried = digest(self.open.pop(), carried)
            self.log.append(carried)
            filled >>= 1
        self.open.append(carried)
        self.n += 1

    def close(self, levels: int) -> str:
        """Complete the ragged edge up to ``levels`` and return the root."""
        carried = None
        for level in range(levels):
            if self.n >> level & 1:
                carried = digest(self.open.pop(), *([] if carried is None else [carried]))
                self.log.append(carried)
            elif carried is not None:
                carried = digest(carried)
                self.log.append(carried)
        return carried if carried is not None else self.open[0]


def text_of(value: Column) -> Column:
    """A field as it enters its leaf: ``-`` if null, else its byte count, a colon and itself."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[text_of(v.cast("string")) for v in values]).cast("binary"), 256)


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``i``, the place of each in its tree by ``order`` (nulls first), and ``n``, its leaves.

    Row order is written down as it is after sorting inside range partitions; places then follow
    from the counts of (partition, tree), few rows that a window adds up.
    """
    kept = store(rows.withColumn("given", F.monotonically_increasing_id()), "unsorted")
    names = [tree, *order, "given"]
    sorted_ = kept.repartitionByRange(fanout(rows.sparkSession), *names).sortWithinPartitions(*names).drop("given")
    placed = store(sorted_.withColumn("row", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("row", 33)
    runs = placed.groupBy(part.alias("part"), tree).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    runs = store(runs.select("part", F.col(tree).alias("in_tree"), "first", before.alias("before"), F.sum("n").over(Window.partitionBy(tree)).alias("n")), "runs")
    met = placed.withColumn("at", part).join(runs, (F.col("at") == F.col("part")) & F.col(tree).eqNullSafe(F.col("in_tree")))
    return met.select(*rows.columns, (F.col("row") - F.col("first") + F.col("before")).alias("i"), "n")


def _levels(total: int, up: int) -> int:
    """Levels of a block's log: up to its root, or that of the whole tree if that is lower."""
    return up if total > 1 << up else height(total)


def _build(batches: Iterator[pa.RecordBatch], up: int) -> Iterator[pa.RecordBatch]:
    """Logs of the blocks whose leaves (tree, block, i, n, leaf) come adjacent and in order."""
    unit, builder, total = None, Builder(), 0
    out: list[tuple] = []

    def close() -> None:
        tree, block = unit
        root = builder.close(_levels(total, up))
        out.append((tree, block, builder.n, total, root, bytes.fromhex("".join(builder.log))))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["tree", "block", "leaves", "n", "root", "log"])
        out.clear()
        return batch

    for batch in batches:
        for tree, block, _, n, leaf in zip(*[c.to_pylist() for c in batch.columns]):
            if (tree, block) != unit:
                if unit is not None:
                    close()
                    if len(out) >= 16:
                        yield flush()
                unit, builder, total = (tree, block), Builder(), n
            builder.add(leaf)
    if unit is not None:
        close()
    if out:
        yield flush()


LOG = "tree long, block long, leaves long, n long, root string, log binary"


def build_tier(leaves: DataFrame, up: int = HEIGHT) -> DataFrame:
    """Logs of all blocks over ``tree, i, n, leaf``."""
    rows = leaves.select("tree", F.shiftright("i", up).alias("block"), "i", "n", "leaf")
    ready = rows.repartition(fanout(leaves.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "i")
    return store(ready.mapInArrow(partial(_build, up=up), LOG), "log")


def build(leaves: DataFrame, up: int = HEIGHT) -> list[DataFrame]:
    """The tiers of all trees over ``tree, i, n, leaf``, lowest first; a tree ends where it is one block."""
    tiers = [build_tier(leaves, up)]
    while not (upper := tiers[-1].where(F.col("n") > 1 << up)).isEmpty():
        above = upper.select("tree", F.col("block").alias("i"), F.ceil(F.col("n") / (1 << up)).cast("long").alias("n"), F.col("root").alias("leaf"))
        tiers.append(build_tier(above, up))
    return tiers


def roots(tiers: list[DataFrame], up: int = HEIGHT) -> DataFrame:
    """``tree, root``: the root of the block that is a whole tree."""
    ends = [t.where(F.col("n") <= 1 << up).select("tree", "root") for t in tiers]
    found = ends[0]
    for more in ends[1:]:
        found = found.union(more)
    return found


class Path:
    """Siblings upwards from a node: their sides (1 left, 0 right, 2 none) and hex digests."""

    def __init__(self, packed: bytes | None) -> None:
        packed = packed or b""
        self.sides = packed[: len(packed) // (WIDTH + 1)]
        self.held = packed[len(self.sides) :].hex()

    @staticmethod
    def pack(sides: bytes, held: bytes) -> bytes:
        return sides + held


def read_siblings(log: bytes, i: int, n: int, levels: int) -> tuple[bytes, bytes]:
    """Sides and digests of the siblings of leaf ``i``, read from its block's log."""
    sides, held = bytearray(), []
    for at, side in siblings(i, n, levels):
        sides.append(2 if at < 0 else side)
        held.append(bytes(WIDTH) if at < 0 else log[at * WIDTH : (at + 1) * WIDTH])
    return bytes(sides), b"".join(held)


def fold(leaf: str, sides: bytes, held: str) -> str:
    """The root that a leaf and its siblings upwards lead to."""
    carried = leaf
    for k, side in enumerate(sides):
        other = held[2 * WIDTH * k : 2 * WIDTH * (k + 1)]
        carried = digest(carried) if side == 2 else digest(other, carried) if side else digest(carried, other)
    return carried


def proof_digest(sides: bytes, held: str) -> str:
    return digest(*[held[2 * WIDTH * k : 2 * WIDTH * (k + 1)] for k, side in enumerate(sides) if side != 2])


def _descend(batches: Iterator[pa.RecordBatch], up: int) -> Iterator[pa.RecordBatch]:
    """The path above every leaf of a block: its siblings in the block, then the block's own path."""
    for batch in batches:
        for tree, block, leaves, n, log, above in zip(*[c.to_pylist() for c in batch.columns]):
            levels, path = _levels(n, up), Path(above)
            out = []
            for i in range(leaves):
                sides, held = read_siblings(log, i, leaves, levels)
                out.append(Path.pack(sides + path.sides, held + bytes.fromhex(path.held)))
            at = (block << up) + pa.array(range(leaves), pa.int64()).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([tree] * leaves, pa.int64()), pa.array(at), pa.array(out, pa.binary())], ["tree", "i", "above"])


def _prove(batches: Iterator[pa.RecordBatch], up: int) -> Iterator[pa.RecordBatch]:
    """Proofs of leaves: each block's log comes first, its leaves after it."""
    log, leaves, total, path = b"", 0, 0, Path(None)
    for batch in batches:
        at = {name: k for k, name in enumerate(batch.schema.names)}
        rows, proofs, folded = [], [], []
        columns = [batch.column(at[c]).to_pylist() for c in ("i", "n", "leaves", "leaf", "shown", "log", "above")]
        for k, (i, n, held_leaves, leaf, shown, held_log, above) in enumerate(zip(*columns)):
            if held_log is not None:
                log, leaves, total, path = held_log, held_leaves, n, Path(above)
                continue
            sides, held = read_siblings(log, i & ((1 << up) - 1), leaves, _levels(total, up))
            sides, held = sides + path.sides, held.hex() + path.held
            rows.append(k)
            proofs.append(proof_digest(sides, held))
            folded.append(fold(shown, sides, held))
        taken = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [taken.column(at["pack"]), taken.column(at["tree"]), taken.column(at["leaf"]), pa.array(proofs, pa.string()), pa.array(folded, pa.string())],
            ["pack", "tree", "leaf", "proof_sha256", "folded_root"],
        )


def paths(tiers: list[DataFrame], above: DataFrame, up: int = HEIGHT) -> DataFrame:
    """``tree, block, above`` for the blocks of the lowest tier, given ``tree, above`` of whole trees."""
    down = None
    for tier in reversed(tiers):
        whole = tier.where(F.col("n") <= 1 << up).join(above, "tree").select("tree", "block", "leaves", "n", "log", "above")
        known = whole
        if down is not None:
            part = tier.where(F.col("n") > 1 << up).join(down.select("tree", F.col("i").alias("block"), "above"), ["tree", "block"])
            known = whole.union(part.select("tree", "block", "leaves", "n", "log", "above"))
        if tier is tiers[0]:
            return known
        down = store(known.mapInArrow(partial(_descend, up=up), "tree long, i long, above binary"), "paths")
    raise ValueError("a tree has a tier")


def manifest(
    rows: DataFrame, fields: dict[str, Column], keep: list[str], tree: str = "lang", key: str = "doc_id", shown: dict[str, Column] | None = None, height: int = HEIGHT
) -> DataFrame:
    """A leaf per row, a tree per value of ``tree``, one tree over their roots, and a proof per leaf.

    ``fields`` are the hashed columns in order; ``shown`` replaces some of them in the leaf that is
    folded to a root with the original siblings. Returns ``pack`` (the kept columns), ``leaf,
    subroot, root, proof_sha256, folded_root, verified``. Leaves ascend by key, nulls first, equal
    keys by leaf; trees ascend by name, null first. Rows alike in all fields have leaves of their
    own. An empty table gives an empty result; other columns may bear any name. Tree names are
    ranked in one task, a row for each.
    """
    original = [fields[f] for f in fields]
    altered = [(shown or {}).get(f, fields[f]) for f in fields]
    leaves = rows.select(
        packed(rows, *keep).alias("pack"),
        field(tree).cast("string").alias("name"),
        field(key).alias("key"),
        leaf_of(*original).alias("leaf"),
        leaf_of(*altered).alias("shown"),
    )
    placed = numbered(leaves, "name", "key", "leaf")
    names = placed.groupBy("name").agg(F.count("*").alias("n"))
    names = store(names.select("name", (F.row_number().over(Window.orderBy(F.col("name").asc_nulls_first())) - 1).cast("long").alias("tree")), "trees")
    named = names.withColumnRenamed("name", "of")
    placed = store(placed.join(named, F.col("name").eqNullSafe(F.col("of"))).select("pack", "tree", "i", "n", "leaf", "shown"), "leaves")
    tiers = build(placed, height)
    subroots = store(roots(tiers, height), "subroots")
    count = F.count("*").over(Window.partitionBy()).alias("n")
    top = build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), count, F.col("root").alias("leaf")), height)
    root = roots(top, height).select(F.col("root").alias("top"))
    nothing = F.lit(b"").cast("binary")
    blocks = paths(top, roots(top, height).select("tree", nothing.alias("above")), height)
    above = store(blocks.mapInArrow(partial(_descend, up=height), "tree long, i long, above binary").select(F.col("i").alias("tree"), "above"), "tops")
    known = store(paths(tiers, above, height), "known")
    none = F.lit(None)
    logs = known.select(none.cast(placed.schema["pack"].dataType).alias("pack"), "tree", "block", F.lit(-1).cast("long").alias("i"), "n", "leaves", none.cast("string").alias("leaf"), none.cast("string").alias("shown"), "log", "above")
    items = placed.select("pack", "tree", F.shiftright("i", height).alias("block"), "i", "n", none.cast("long").alias("leaves"), "leaf", "shown", none.cast("binary").alias("log"), none.cast("binary").alias("above"))
    ready = logs.union(items).repartition(fanout(rows.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "i")
    schema = f"pack {placed.schema['pack'].dataType.simpleString()}, tree long, leaf string, proof_sha256 string, folded_root string"
    proved = ready.mapInArrow(partial(_prove, up=height), schema)
    ends = _with_root(subroots, root)
    return proved.join(ends, "tree").select(
        "pack", "leaf", "subroot", F.col("top").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.col("top")).alias("verified")
    )


def _with_root(subroots: DataFrame, root: DataFrame) -> DataFrame:
    """Subroots beside the root of all, met under a constant key (one row on one side)."""
    one = F.lit(1).alias("one")
    return store(subroots.select(one, "tree", F.col("root").alias("subroot")).join(root.select(one, "top"), "one").drop("one"), "ends")
