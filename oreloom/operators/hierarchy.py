"""Parent-child links to full hierarchies by tree contraction (problem 5).

Contraction alternates raking (all leaves fold into their parents) and compression (an independent set of nodes with one
child leaves the chain, its child takes its place); each step records what it removes. The records are then undone in
reverse and give every node its root, depth, path and number of descendants. A core that no step can empty is a loop.
The number of steps grows with the logarithm of the number of nodes, not with the depth of the trees.

A group whose links fit one part is contracted inside it, on integer arrays; a larger (hot) group is contracted across
parts by joins, its nodes spread by hash, until what is left of it fits. Both do the same steps at every size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreloom.session import cut, release

#: Links of one group that one task contracts by itself; a task never holds more than about three times as many rows.
PART_ROWS = 50_000
#: Names in the paths that are spelt out at a time.
PATH_BLOCK = 2_000_000
#: Large groups whose names may be broadcast (under 1 MB); more of them are joined by a shuffle.
BROADCAST_GROUPS = 5_000
ON_LOOP, BELOW_LOOP = -1, -2
_KEY = ["gn", "g", "v"]


def _copy(out: np.ndarray, to: np.ndarray, source: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
    """out[to : to + length] = source[at : at + length] for many slices at once."""
    total = int(length.sum())
    step = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + step] = source[np.repeat(at, length) + step]


class Contraction:
    """Contracts a forest with loops given as integer arrays and undoes the records.

    parent: -1 for none. own: nodes that a node stands for. seg: the names from below the parent down to the node, as
    slices (at, size) of pool. After run(): root (-1 for loops and below), depth and total (the node and all below it).
    """

    def __init__(self, parent: np.ndarray, own: np.ndarray, pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        self.p, self.own, self.at, self.size, self.pool = parent.copy(), own.copy(), at.copy(), size.copy(), pool
        self.steps: list[tuple[np.ndarray, np.ndarray | None]] = []

    def run(self) -> None:
        n = len(self.p)
        active, rng = np.arange(n), np.random.default_rng(5)
        while True:
            below = active[(self.p[active] >= 0) & (self.p[active] != active)]
            if not len(below):
                break
            active, below = self._rake(active, below)
            active = self._compress(active, below, rng.random(n) < 0.5)
        self._undo(active)

    def _rake(self, active: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.p)
        parents = np.zeros(n, bool)
        parents[self.p[below]] = True
        leaf = ~parents[below]
        leaves = below[leaf]
        if len(leaves):
            self.own += np.bincount(self.p[leaves], self.own[leaves], n).astype(np.int64)
            self.steps.append((leaves, None))
            gone = np.zeros(n, bool)
            gone[leaves] = True
            active, below = active[~gone[active]], below[~leaf]
        return active, below

    def _compress(self, active: np.ndarray, below: np.ndarray, coin: np.ndarray) -> np.ndarray:
        n = len(self.p)
        kids, kid = np.bincount(self.p[below], minlength=n), np.full(n, -1)
        kid[self.p[below]] = below
        u = below[kids[below] == 1]
        u = u[coin[u] & ~coin[kid[u]]]
        if not len(u):
            return active
        c, up = kid[u], self.p[u]
        self.own += np.bincount(up, self.own[u], n).astype(np.int64)
        size = self.size[u] + self.size[c]
        at = len(self.pool) + np.cumsum(size) - size
        pool = np.empty(len(self.pool) + int(size.sum()), self.pool.dtype)
        pool[: len(self.pool)] = self.pool
        _copy(pool, at, self.pool, self.at[u], self.size[u])
        _copy(pool, at + self.size[u], self.pool, self.at[c], self.size[c])
        self.pool, self.at[c], self.size[c], self.p[c] = pool, at, size, up
        self.steps.append((u, c))
        gone = np.zeros(n, bool)
        gone[u] = True
        return active[~gone[active]]

    def _undo(self, core: np.ndarray) -> None:
        n = len(self.p)
        self.root, self.depth, self.total = np.full(n, -1), np.zeros(n, np.int64), self.own.copy()
        looped = self.p[core] == core
        self.depth[core[looped]] = ON_LOOP
        self.root[core[~looped]] = core[~looped]
        for nodes, kid in reversed(self.steps):
            p = self.p[nodes]
            lost = self.depth[p] < 0
            self.depth[nodes] = np.where(lost, BELOW_LOOP, self.depth[p] + self.size[nodes])
            self.root[nodes] = np.where(lost, -1, self.root[p])
            if kid is not None:
                on = self.depth[kid] == ON_LOOP
                self.depth[nodes[on]] = ON_LOOP
                self.total[nodes] = np.where(on, 0, self.own[nodes]) + self.total[kid]

    def paths(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, pool entries) of the paths of nodes, walking up the records; loops and what is below have none."""
        size = np.where(self.depth[nodes] >= 0, self.depth[nodes] + 1, 0)
        end = np.cumsum(size)
        flat, offsets = np.empty(int(end[-1]) if len(end) else 0, self.pool.dtype), np.concatenate([[0], end])
        end, here = end[size > 0], nodes[size > 0]
        while len(here):
            _copy(flat, end - self.size[here], self.pool, self.at[here], self.size[here])
            end, here = end - self.size[here], self.p[here]
            end, here = end[here >= 0], here[here >= 0]
        return offsets, flat


def _contracted(chunk: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, Contraction]:
    """Groups, names in order, group and name of each node, and the contraction of complete groups of links."""
    groups = chunk["g"].combine_chunks().dictionary_encode()
    g = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = [chunk[c].combine_chunks() for c in ("child", "parent")]
    segs = chunk["seg"].combine_chunks()
    spelt = pa.concat_arrays([*ends, segs.flatten()]).dictionary_encode()
    order = pc.sort_indices(spelt.dictionary)
    rank = np.empty(max(1, len(order)), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = spelt.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.where(code >= 0, rank[code], -1)
    rows, names = len(chunk), max(1, len(order))
    child, parent, told = code[:rows], code[rows : 2 * rows], code[2 * rows :]
    has_c, has_p = child >= 0, parent >= 0
    keys, inverse = np.unique(np.concatenate([(g * names + child)[has_c], (g * names + parent)[has_p]]), return_inverse=True)
    n, of_child = len(keys), np.full(rows, -1)
    of_child[has_c] = inverse[: has_c.sum()]
    least = np.full(n, names)
    both = has_c & has_p
    np.minimum.at(least, of_child[both], parent[both])
    above = np.where(least < names, np.searchsorted(keys, keys // names * names + least), -1)
    own, pool, at, size = np.ones(n, np.int64), keys % names, np.arange(n), np.ones(n, np.int64)
    given = has_c & segs.is_valid().to_numpy(zero_copy_only=False)
    if given.any():  # what is left of a large group: every row a node with what it stands for
        lengths = pc.list_value_length(segs).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        node = of_child[given]
        own[node] = chunk["own"].combine_chunks().to_numpy(zero_copy_only=False)[given]
        at[node], size[node] = (n + np.cumsum(lengths) - lengths)[given], lengths[given]
        pool = np.concatenate([pool, told])
    contraction = Contraction(above, own, pool, at, size)
    contraction.run()
    return groups.dictionary, spelt.dictionary.take(order), keys // names, keys % names, contraction


def _resolver(spell: str, part_rows: int):  # noqa: ANN202
    """Function over sorted partitions of links: contracts some complete groups at a time; paths as 'text' or 'steps'."""

    def rows_of(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        groups, names, g, v, done = _contracted(chunk)
        block = np.cumsum(np.where(done.depth >= 0, done.depth + 1, 1)) // PATH_BLOCK
        for b in np.unique(block):
            nodes = np.flatnonzero(block == b)
            offsets, flat = done.paths(nodes)
            path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(flat)))
            root = done.root[nodes]
            yield pa.RecordBatch.from_arrays(
                [
                    groups.take(pa.array(g[nodes])),
                    names.take(pa.array(v[nodes])),
                    names.take(pa.array(np.where(root >= 0, v[root], -1), mask=root < 0)).fill_null(""),
                    pa.array(done.depth[nodes], pa.int32()),
                    pc.binary_join(path, ">") if spell == "text" else path,
                    pa.array(done.total[nodes], pa.int64()),
                ],
                names=["g", "v", "root", "depth", "path", "total"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < part_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            g = table["g"].combine_chunks().dictionary_encode().indices.to_numpy()
            whole = int(np.argmax(g == g[-1]))  # sorted: the last group may go on in the next batch
            if whole:
                yield from rows_of(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if sum(map(len, held)):
            yield from rows_of(pa.Table.from_batches(held).combine_chunks())

    return run


def _within_parts(rows: DataFrame, spell: str, part_rows: int) -> DataFrame:
    """Results of groups that fit one part: one shuffle by group, then a stream of complete groups."""
    path = "string" if spell == "text" else "array<string>"
    named = rows.select(F.when(F.col("gn"), "0").otherwise(F.concat(F.lit("1"), "g")).alias("g"), "parent", "child", "own", "seg")
    # Groups need only be side by side; by their hash most comparisons of the sort end at one number.
    out = named.repartition("g").sortWithinPartitions(F.xxhash64("g"), "g").mapInArrow(
        _resolver(spell, part_rows), f"g string, v string, root string, depth int, path {path}, total bigint"
    )
    return out.withColumns({"gn": F.col("g") == "0", "g": F.substring("g", 2, 2**30)}).select("gn", "g", "v", "root", "depth", "path", "total")


def _rake(state: DataFrame, kids: DataFrame) -> DataFrame:
    """All leaves leave, their parents stand for them."""
    seen = state.join(kids, _KEY, "left").withColumn(
        "what",
        F.when(F.col("n_kids").isNotNull(), "stay").when(F.col("p").isNull() | (F.col("p") == F.col("v")), "done").otherwise("leaf"),
    )
    gained = seen.filter("what = 'leaf'").groupBy("gn", "g", F.col("p").alias("v")).agg(F.sum("own").alias("gained"))
    return seen.join(gained, _KEY, "left").select(
        *_KEY, "p", "seg", (F.col("own") + F.coalesce("gained", F.lit(0))).alias("own"), F.lit(None).cast("string").alias("kid"), "what"
    )


def _compress(state: DataFrame, kids: DataFrame, number: int) -> DataFrame:
    """Nodes with one child, by coin never two in a row, leave; the child takes their parent and lengthens its segment."""
    coin = lambda c: F.pmod(F.xxhash64("g", c, F.lit(number)), F.lit(2))
    inner = F.col("p").isNotNull() & (F.col("p") != F.col("v")) & (F.col("n_kids") == 1)
    chain = inner & (coin("v") == 1) & (coin("kid") == 0)
    seen = state.join(kids, _KEY, "left").withColumn("what", F.when(chain, "chain").otherwise("stay"))
    left = seen.filter("what = 'chain'")
    none = lambda kind: F.lit(None).cast(kind)
    said = left.select("gn", "g", F.col("kid").alias("v"), F.col("p").alias("up"), F.col("seg").alias("up_seg"), none("bigint").alias("gained")).unionByName(
        left.select("gn", "g", F.col("p").alias("v"), none("string").alias("up"), none("array<string>").alias("up_seg"), F.col("own").alias("gained"))
    )
    said = said.groupBy(*_KEY).agg(F.max("up").alias("up"), F.max("up_seg").alias("up_seg"), F.sum("gained").alias("gained"))
    return seen.join(said, _KEY, "left").select(
        *_KEY,
        F.coalesce("up", "p").alias("p"),
        F.when(F.col("up").isNotNull(), F.concat("up_seg", "seg")).otherwise(F.col("seg")).alias("seg"),
        (F.col("own") + F.coalesce("gained", F.lit(0))).alias("own"),
        F.when(F.col("what") == "chain", F.col("kid")).alias("kid"),
        "what",
    )


def _undo(record: DataFrame, known: DataFrame) -> DataFrame:
    """Results of the nodes that a step removed, beside those already known."""
    on_loop = F.col("p").isNotNull()
    done = record.filter("what = 'done'").select(
        *_KEY,
        F.when(on_loop, "").otherwise(F.col("v")).alias("root"),
        F.when(on_loop, ON_LOOP).otherwise(0).alias("depth"),
        F.when(on_loop, F.array().cast("array<string>")).otherwise(F.col("seg")).alias("path"),
        F.col("own").alias("total"),
    )
    above = known.select("gn", "g", F.col("v").alias("p"), "root", F.col("depth").alias("p_depth"), F.col("path").alias("p_path"))
    kids = known.select("gn", "g", F.col("v").alias("kid"), F.col("depth").alias("k_depth"), F.col("total").alias("k_total"))
    lost, looped = F.col("p_depth") < 0, F.coalesce(F.col("k_depth") == ON_LOOP, F.lit(False))
    removed = record.filter("what IN ('leaf', 'chain')").join(above, ["gn", "g", "p"]).join(kids, ["gn", "g", "kid"], "left").select(
        *_KEY,
        "root",
        F.when(looped, ON_LOOP).when(lost, BELOW_LOOP).otherwise(F.col("p_depth") + F.size("seg")).cast("int").alias("depth"),
        F.when(lost, F.array().cast("array<string>")).otherwise(F.concat("p_path", "seg")).alias("path"),
        (F.when(looped, 0).otherwise(F.col("own")) + F.coalesce("k_total", F.lit(0))).alias("total"),
    )
    return known.unionByName(done).unionByName(removed)


def _across_parts(links: DataFrame, part_rows: int) -> DataFrame:
    """Results of groups too large for one part: steps over all their nodes until what is left of each group fits."""
    both = F.array(F.struct(F.col("child").alias("v"), F.col("parent").alias("p")), F.struct(F.col("parent").alias("v"), F.lit(None).cast("string").alias("p")))
    ends = links.select("gn", "g", F.inline(both))
    nodes = ends.filter("v IS NOT NULL").groupBy(*_KEY).agg(F.min("p").alias("p"))
    record = cut(nodes.select(*_KEY, "p", F.array("v").alias("seg"), F.lit(1).cast("bigint").alias("own"), F.lit("stay").alias("what")))
    records: list[DataFrame] = []
    state = record
    while (state.groupBy("gn", "g").count().agg(F.max("count")).first()[0] or 0) > part_rows:
        linked = state.filter("p IS NOT NULL AND p <> v")
        kids = linked.groupBy("gn", "g", F.col("p").alias("v")).agg(F.count("*").alias("n_kids"), F.min("v").alias("kid"))
        number = len(records)
        step = _rake(state, kids.drop("kid")) if number % 2 == 0 else _compress(state, kids, number)
        last, record = record, cut(step)
        if number == 0:
            release(last)
        records.append(record)
        state = record.filter("what = 'stay'").select(*_KEY, "p", "seg", "own")
    core = state.select("gn", "g", F.col("p").alias("parent"), F.col("v").alias("child"), "own", "seg")
    known = cut(_within_parts(core, "steps", part_rows))
    while records:
        last, record = known, records.pop()
        known = cut(_undo(record, known))
        release(last, record)
    return known


def hierarchies(links: DataFrame, part_rows: int = PART_ROWS, steps: bool = False) -> DataFrame:
    """Full hierarchies of ``links`` (g, parent, child; normalised keys, nulls allowed at either end).

    Result: g, node_id, root_id, node_depth, node_path, n_descendants, one row per node. A row with one end only makes
    that node known; links without a group are a group; a node with several parents belongs to the smallest of them; a
    node on a loop has depth -1, one below a loop -2, both with empty root and path. An empty table gives none.
    steps: node_path is the array of ids instead of the text joined by '>', which tells ids that hold a '>' apart.
    """
    links = links.select(F.col("g").isNull().alias("gn"), F.coalesce("g", F.lit("")).alias("g"), "parent", "child")
    large = cut(links.groupBy("gn", "g").count().filter(F.col("count") > part_rows).select("gn", "g"))
    n_large = large.count()
    marked = F.broadcast(large) if n_large <= BROADCAST_GROUPS else large
    bare = links.withColumns({"own": F.lit(None).cast("bigint"), "seg": F.lit(None).cast("array<string>")})
    small = bare if n_large == 0 else bare.join(marked, ["gn", "g"], "left_anti")
    known = _within_parts(small, "steps" if steps else "text", part_rows)
    if n_large:
        spread = _across_parts(links.join(marked, ["gn", "g"], "left_semi"), part_rows)
        known = known.unionByName(spread if steps else spread.withColumn("path", F.array_join("path", ">")))
    return known.select(_group(), F.col("v").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"),
                        F.col("path").alias("node_path"), (F.col("total") - 1).alias("n_descendants"))


def _group() -> Column:
    return F.when(~F.col("gn"), F.col("g")).alias("g")


def descendants(known: DataFrame) -> DataFrame:
    """(g, node_id, descendant_id) from the results of hierarchies(steps=True); loops have none. Its size is the sum of the depths."""
    above = F.slice("node_path", 1, F.col("node_depth"))
    return known.filter("node_depth > 0").select("g", F.explode(above).alias("node_id"), F.col("node_id").alias("descendant_id"))
