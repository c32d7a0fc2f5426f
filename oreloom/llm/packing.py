"""Filling fixed-capacity containers with items under mixture control (problem 8).

Deficit round-robin over one queue per source draws the items of every window at the target token proportions (the
corpus's own unless others are given); deficits carry over from window to window and, through prefix sums, from bucket to
bucket. The pieces of a window go into the open containers by best fit, longest first. A source is never drawn beyond its
credit and lags by less than its next item, so that as long as all its queues last, a bucket's mixture is off by at most
one item a source. Queues that last longer than the others are packed at the proportions of what is left; no item is lost.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreloom.llm.tokens import TOKENIZER, encode_corpus
from oreloom.session import cut

CAPACITY = 2048
#: Containers that a window is meant to fill.
WINDOW_CONTAINERS = 64
#: Tokens and items per bucket, whichever makes more buckets; one task packs one bucket of about 12,000 to 200,000 items.
BUCKET_TOKENS, BUCKET_ITEMS = 16_000_000, 200_000
#: Weight of a source without a target: it waits until the others are drained.
_LEAST = 1e-6
_OUT = "piece int, container_id bigint, window_id bigint, token_from bigint, n_tokens int, source string"


class Filler:
    """Open containers of one bucket by free space; the fullest that takes a piece gets it."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.free = capacity, defaultdict(list)
        self.mask, self.window = 0, 0
        self.opened: list[int] = []  # window in which each container was opened

    def put(self, size: int) -> int:
        fit = self.mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            container = self.free[room].pop()
            if not self.free[room]:
                self.mask &= ~(1 << room)
        else:
            room, container = self.capacity, len(self.opened)
            self.opened.append(self.window)
        left = room - size
        if left:
            self.free[left].append(container)
            self.mask |= 1 << left
        return container


def pack_bucket(ids: list, sizes: list[int], sources: list[str], deficit: dict[str, float], share: dict[str, float], capacity: int, window: int) -> list[tuple]:
    """(id, piece, container, window, token_from, n_tokens, source) of one bucket, in the order of packing."""
    queues: dict[str, list[tuple]] = defaultdict(list)
    for i, n, s in sorted(zip(ids, sizes, sources, strict=True), reverse=True):
        queues[s].append((i, n))
    credit = {s: deficit.get(s, 0.0) for s in queues}
    filler, out = Filler(capacity), []
    while queues:
        weight = {s: max(share.get(s, 0.0), _LEAST) for s in queues}
        quantum = {s: w / sum(weight.values()) * window for s, w in weight.items()}
        batch = []
        for s in sorted(queues):
            credit[s] += quantum[s]
            queue = queues[s]
            while queue and queue[-1][1] <= credit[s]:
                i, n = queue.pop()
                credit[s] -= n
                for piece in range(max(1, math.ceil(n / capacity))):
                    batch.append((min(capacity, n - piece * capacity), i, piece, s))
            if not queue:
                del queues[s]
        if not batch and queues:  # nothing affordable: let the credit of the nearest queue grow at once
            waits = min(math.ceil((q[-1][1] - credit[s]) / quantum[s]) for s, q in queues.items())
            for s in queues:
                credit[s] += max(0, waits - 1) * quantum[s]
        for n, i, piece, s in sorted(batch, key=lambda b: (-b[0], b[1], b[2])):
            container = filler.put(n) if n or not filler.opened else len(filler.opened) - 1
            out.append((i, piece, container, filler.opened[container], piece * capacity, n, s))
        filler.window += 1
    return out


def _targets(shares: DataFrame, targets: dict[str, float] | None) -> Column:
    """Share of each source: the given one, 0 for a source not named; else its own part of all tokens."""
    if targets is None:
        return F.col("own_share")
    total = sum(targets.values()) or 1.0
    given = F.create_map(*[F.lit(x) for s, t in targets.items() for x in (s, t / total)]) if targets else F.create_map().cast("map<string,double>")
    return F.coalesce(F.try_element_at(given, F.col(shares.columns[0])), F.lit(0.0))


def pack_items(
    sizes: DataFrame, capacity: int = CAPACITY, bucket_tokens: int = BUCKET_TOKENS, window_containers: int = WINDOW_CONTAINERS,
    targets: dict[str, float] | None = None, bucket_items: int = BUCKET_ITEMS,
) -> DataFrame:
    """Assign items (doc_id, source, n_tokens) to containers: doc_id, piece, container_id, window_id, token_from, n_tokens, source.

    An item is split only if it exceeds the capacity. Items without tokens take no room but get a container too;
    a null source is a queue of its own (''); ids must be unique. An empty table gives no rows. window_id is the window in
    which the container was opened. targets: wanted proportions of tokens by source. What is carried to a bucket is a prefix
    sum over the buckets, one task's work: two million of them at 10 trillion tokens.
    """
    total, count = sizes.agg(F.sum("n_tokens"), F.count("*")).first()
    total = total or 0
    buckets = max(1, math.ceil(total / bucket_tokens), math.ceil(count / bucket_items))
    items = sizes.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"),
    )
    per = items.groupBy("bucket", "source").agg(F.sum("n_tokens").alias("own"))
    of_bucket = per.groupBy("bucket").agg(F.sum("own").alias("all"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = of_bucket.withColumn("all_before", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
    queue = per.groupBy("source").agg((F.sum("own") / F.lit(max(total, 1))).alias("own_share"))
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own_before = F.coalesce(F.sum("own").over(by_source), F.lit(0))
    carried = (
        per.withColumn("own_before", own_before)
        .join(before, "bucket")
        .join(queue.select("source", "own_share", _targets(queue, targets).alias("share")), "source")
        .select(
            F.col("bucket").alias("to_bucket"),
            F.col("source").alias("queue"),
            "share",
            (F.col("own_share") * F.col("all_before") - F.col("own_before")).alias("deficit"),
        )
    )

    def run(key: tuple, mine: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        rows = pack_bucket(
            mine["doc_id"].tolist(),
            mine["n_tokens"].tolist(),
            mine["source"].tolist(),
            dict(zip(carry["queue"], carry["deficit"], strict=True)),
            dict(zip(carry["queue"], carry["share"], strict=True)),
            capacity,
            capacity * window_containers,
        )
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "container_id", "window_id", "token_from", "n_tokens", "source"])
        for name in ("container_id", "window_id"):
            out[name] = np.int64(key[0]) * (1 << 32) + out[name].astype("int64")
        return out

    id_type = sizes.schema["doc_id"].dataType.simpleString()
    return items.groupBy("bucket").cogroup(carried.groupBy("to_bucket")).applyInPandas(run, f"doc_id {id_type}, {_OUT}")


def window_mixture(packed: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """window_id, n_tokens, deviation: the largest difference between a source's part of the window's tokens and its target, over
    all sources, those too that the window lacks. The targets travel as one row; a window's sources fit one row, as a bucket's
    queues fit one task.
    """
    drawn = packed.groupBy("window_id", "source").agg(F.sum("n_tokens").alias("n"))
    of_source = drawn.groupBy("source").agg(F.sum("n").alias("n"))
    whole = of_source.agg(F.sum("n").alias("whole"))
    shares = of_source.join(whole).withColumn("own_share", F.col("n") / F.greatest("whole", F.lit(1)))
    wanted = shares.select(F.struct("source", _targets(shares, targets).alias("target")).alias("w")).agg(F.collect_list("w").alias("wanted"))
    windows = drawn.groupBy("window_id").agg(F.sum("n").alias("n_tokens"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("held"))
    part = lambda w: F.coalesce(F.try_element_at("held", w["source"]), F.lit(0)) / F.greatest("n_tokens", F.lit(1))
    apart = F.array_max(F.transform("wanted", lambda w: F.abs(part(w) - w["target"])))
    return windows.join(wanted).select("window_id", "n_tokens", apart.alias("deviation"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, **how: object) -> DataFrame:
    """Pack the texts of documents (doc_id, text, source), sized in tokens, into containers."""
    sizes = cut(encode_corpus(documents, tokenizer=tokenizer, count_only=True, carry=("source",)))
    return pack_items(sizes, capacity, **how)


def packing_audit(packed: DataFrame, documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of what must hold: n_items packed, and how many are missing or unknown (n_lost), split without need or into
    wrong pieces (n_torn), and how many containers hold more than they may (n_over) or have no window (n_loose).
    """
    pieces = packed.groupBy("doc_id").agg(
        F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.countDistinct("piece").alias("d"), F.max("piece").alias("last"),
        F.count_if((F.col("token_from") != F.col("piece") * capacity) | (F.col("n_tokens") > capacity)).alias("odd"),
    )
    torn = (F.col("odd") > 0) | (F.col("k") != F.col("d")) | (F.col("last") != F.col("d") - 1) | (F.col("k") != F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)))
    met = pieces.join(documents.select("doc_id", F.lit(1).alias("known")).distinct(), "doc_id", "full")
    of_items = met.agg(F.count("k").alias("n_items"), F.count_if(F.col("k").isNull() | F.col("known").isNull()).alias("n_lost"), F.count_if(torn).alias("n_torn"))
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.countDistinct("window_id").alias("w"))
    of_boxes = boxes.agg(F.count_if(F.col("used") > capacity).alias("n_over"), F.count_if(F.col("w") != 1).alias("n_loose"))
    return of_items.join(of_boxes)


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens and the share of room used, overall: one row."""
    used = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return used.agg(
        F.count("*").alias("n_containers"),
        F.sum("used").alias("n_tokens"),
        (F.sum("used") / (F.count("*") * capacity)).alias("fill"),
    )
