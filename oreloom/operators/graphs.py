"""Graph analytics of small per-document graphs: orders, reachability, pathways, gates.

A document's graph is bounded by its flowsheet, so one Arrow group per document is resolved in one task; documents
themselves are spread by key. Links of unbounded groups go through the hierarchy operator instead.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Edge = tuple[str, str]


def per_document(edges: DataFrame, solve: Callable[[list[Edge]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows (doc, *solve(edges of doc)) for every doc: one shuffle by doc, then a stream over the sorted partition.

    A document's edges are gathered as plain pairs, so thousands of small documents cost no frame each; only one
    document is held at a time. Null ends must be filtered out before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in schema.split(", ")]
        doc, mine, rows = None, [], []
        for pdf in batches:
            for d, s, t in zip(pdf["doc"].tolist(), pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
                if d != doc:
                    if mine:
                        rows.extend((doc, *r) for r in solve(mine))
                    doc, mine = d, []
                mine.append((s, t))
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=["doc", *columns])
                rows = []
        if mine:
            rows.extend((doc, *r) for r in solve(mine))
        yield pd.DataFrame(rows, columns=["doc", *columns])

    sorted_edges = edges.select("doc", "src", "dst").repartition("doc").sortWithinPartitions("doc")
    return sorted_edges.mapInPandas(run, f"doc string, {schema}")


def _adjacency(edges: list[Edge]) -> tuple[list[str], dict[str, set[str]]]:
    out: dict[str, set[str]] = defaultdict(set)
    for s, d in edges:
        out[s].add(d)
    return sorted({x for e in edges for x in e}), out


def kahn(nodes: list[str], out: dict[str, set[str]], smallest_first: bool) -> list[str]:
    """Topological order; nodes on or behind a cycle come last, sorted. smallest_first picks the least ready node at
    every step, else nodes are served in the order they became ready (sorted among those ready at the start).
    """
    waiting = dict.fromkeys(nodes, 0)
    for s in out:
        for d in out[s]:
            waiting[d] += 1
    ready = sorted(n for n in nodes if waiting[n] == 0)
    order: list[str] = []
    queue = deque(ready)
    while ready if smallest_first else queue:
        n = heapq.heappop(ready) if smallest_first else queue.popleft()
        order.append(n)
        for d in sorted(out.get(n, ())):
            waiting[d] -= 1
            if waiting[d] == 0:
                heapq.heappush(ready, d) if smallest_first else queue.append(d)
    return order + sorted(set(nodes) - set(order))


def topological_order(edges: DataFrame, smallest_first: bool = True) -> DataFrame:
    """H1 (smallest ready node first) and H2 (first in, first out): doc, node, pos from 0. A node with a self-loop is
    never released and lands in the sorted rest.
    """

    return per_document(edges, lambda es: [(n, i) for i, n in enumerate(kahn(*_adjacency(es), smallest_first))], "node string, pos int")


def reachability(edges: DataFrame) -> DataFrame:
    """H3: (doc, src, dst) of all nodes that can be reached from each node; a node never reaches itself here."""

    def solve(es: list[Edge]) -> Iterator[Edge]:
        nodes, out = _adjacency(es)
        for start in nodes:
            seen, queue = {start}, deque([start])
            while queue:
                for d in out.get(queue.popleft(), ()):
                    if d not in seen:
                        seen.add(d)
                        queue.append(d)
            yield from ((start, d) for d in sorted(seen - {start}))

    return per_document(edges, solve, "src string, dst string")


def back_edges_and_depth(edges: DataFrame) -> DataFrame:
    """H7: per doc and edge whether depth-first search (sorted order) closes a cycle with it, and the breadth-first depth
    of its source from the roots (-1 if no root leads there).
    """

    def solve(es: list[Edge]) -> list[tuple]:
        nodes, out = _adjacency(es)
        targets = {d for s in out for d in out[s]}
        depth = {n: 0 for n in nodes if n not in targets}
        queue = deque(sorted(depth))
        while queue:
            n = queue.popleft()
            for d in sorted(out.get(n, ())):
                if d not in depth:
                    depth[d] = depth[n] + 1
                    queue.append(d)
        colour: dict[str, int] = {}
        back = set()
        for start in nodes:
            if start in colour:
                continue
            stack = [(start, iter(sorted(out.get(start, ()))))]
            colour[start] = 1
            while stack:
                n, rest = stack[-1]
                for d in rest:
                    if colour.get(d) == 1:
                        back.add((n, d))
                    elif d not in colour:
                        colour[d] = 1
                        stack.append((d, iter(sorted(out.get(d, ())))))
                        break
                else:
                    colour[n] = 2
                    stack.pop()
        return [(s, d, (s, d) in back, depth.get(s, -1)) for s in nodes for d in sorted(out.get(s, ()))]

    return per_document(edges, solve, "src string, dst string, is_back boolean, src_depth int")


def pathways(weighted: pd.DataFrame, k: int = 8, shortest: int = 3) -> list[list[str]]:
    """H8: greedy pathways of one corpus graph (src, dst, n; a few hundred rows): start at the nodes with the largest
    out-weight less ten times the in-degree, follow the heaviest edge to unvisited nodes, keep those long enough.
    """
    out: dict[str, dict[str, float]] = defaultdict(dict)
    indegree: dict[str, int] = defaultdict(int)
    for s, d, n in zip(weighted["src"], weighted["dst"], weighted["n"], strict=True):
        out[s][d] = float(n)
        indegree[d] += 1
    found = []
    for start in sorted(out, key=lambda s: (-(sum(out[s].values()) - 10 * indegree[s]), s)):
        path, seen = [start], {start}
        while nxt := [(-w, d) for d, w in out.get(path[-1], {}).items() if d not in seen]:
            path.append(min(nxt)[1])
            seen.add(path[-1])
        if len(path) >= shortest:
            found.append(path)
        if len(found) == k:
            break
    return found


def recycle_gate(score: Column, src_order: Column, dst_order: Column, forward: float, recycle: float) -> Column:
    """H9: an edge against the fixed stage order needs the recycle threshold, one along it the forward threshold."""
    return score >= F.when(src_order >= dst_order, F.lit(recycle)).otherwise(F.lit(forward))


def drawn_edges(edges: DataFrame) -> DataFrame:
    """Edges without self-loops, plus derived ones that tie each block that the first root does not reach to it
    (from the first root to the block's first node), per doc; derived marks them.
    """

    def solve(es: list[Edge]) -> list[tuple]:
        nodes, out = _adjacency(es)
        rows = [(s, d, False) for s in nodes for d in sorted(out.get(s, ())) if s != d]
        near: dict[str, set[str]] = defaultdict(set)
        for s, d, _ in rows:
            near[s].add(d)
            near[d].add(s)
        seen: set[str] = set()
        first = nodes[0]
        for n in nodes:
            if n in seen:
                continue
            if seen:
                rows.append((first, n, True))
            queue = deque([n])
            seen.add(n)
            while queue:
                for d in near.get(queue.popleft(), ()):
                    if d not in seen:
                        seen.add(d)
                        queue.append(d)
        return rows

    return per_document(edges, solve, "src string, dst string, derived boolean")


def vote_trace(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Each neighbour's part in each vote: (id, neighbor, label, weight) whose sum per id and label is its score.

    neighbours: id, neighbor, distance; labels: neighbor, label. Weights are inverse distances scaled to 1 per id.
    """
    from pyspark.sql import Window

    w = 1 / (F.col("distance") + 1e-6)
    scaled = neighbours.select("id", "neighbor", "distance", (w / F.sum(w).over(Window.partitionBy("id"))).alias("weight"))
    return scaled.join(labels, "neighbor").select("id", "neighbor", "label", "distance", "weight")


def feature_contributions(near: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, neighbor, distance) -> one row per feature with its part of the squared distance; adds_up: the parts make it up."""
    of = lambda key, name: vectors.select(F.col("id").alias(key), F.col("vec").alias(name))
    both = near.join(of("id", "x"), "id").join(of("neighbor", "y"), "neighbor")
    parts = F.zip_with("x", "y", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    summed = both.withColumn("parts", parts).withColumn("all", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p))
    adds_up = F.abs(F.col("all") - F.col("distance") * F.col("distance")) < 1e-6
    return summed.select("id", "neighbor", adds_up.alias("adds_up"), F.posexplode("parts").alias("feature", "part"))
