"""Best-fit packing under conflicts: no bin holds two pieces of one duplicate cluster, nor more than a few of one source."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import stash, words

#: Words of a bin.
CAPACITY = 2048
#: Pieces of one source that a bin may hold: one bitmap of sources for each.
PER_SOURCE = 2
#: Pieces packed by one call, on average; a shard's bins are its own.
SHARD_PIECES = 4096
SCHEMA = "doc_id long, piece long, first_word long, size long, source string, cluster long, shard long, bin long, bin_size long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int = PER_SOURCE) -> list[int]:
    """Bin of each piece, in the order given.

    Open bins lie in a list ordered by (residual, bin). The search starts at the first bin whose residual is enough and goes on to
    the next until one is compatible: the tightest compatible bin. ``sources`` and ``clusters`` are bit numbers; a cluster of -1
    conflicts with nothing. A bin has one bitmap of clusters and ``per_source`` bitmaps of sources, the k-th saying of which
    sources it holds more than k pieces.
    """
    order: list[tuple[int, int]] = []
    held: list[list[int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held[order[at][1]][0] & c or held[order[at][1]][per_source] & s):
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(held)
            held.append([0] * (per_source + 1))
        bits = held[b]
        bits[0] |= c
        for k in range(1, per_source + 1):
            if not bits[k] & s:
                bits[k] |= s
                break
        if left > size:
            insort(order, (left - size, b))
        out.append(b)
    return out


def split_pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """Documents as pieces of at most ``capacity`` words that cover the whole text; a document without words has none."""
    d = docs.filter(F.col("size") > 0).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / capacity))))
    first = F.col("piece") * capacity
    return d.select("doc_id", "piece", first.alias("first_word"), F.least(F.lit(capacity), F.col("size") - first).cast("long").alias("size"), "source", "cluster")


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """Bins of the documents (doc_id, text, source and, if there is one, cluster).

    Without a column ``cluster``, documents of equal words (A-Z as a-z) are a cluster. Longer documents than a bin are cut into
    pieces, which belong to one cluster and so lie in different bins. A null source is a source of its own; a null cluster
    conflicts with nothing. Documents without words (null, empty, blank) are in no bin. Repeated rows of equal text conflict, as
    copies do. Null doc_id is allowed; an empty table gives an empty result; other columns are ignored. Pieces are dealt to shards
    by hash and packed there, largest first; ties by doc_id, piece and cluster. Returns SCHEMA; bins are numbered in their shard.
    """
    w = words(F.col("text"))
    cluster = F.col("cluster").cast("long") if "cluster" in docs.columns else F.xxhash64(F.transform(w, lambda x: F.lower(x)))
    d = stash(split_pieces(docs.select("doc_id", "source", F.size(w).cast("long").alias("size"), cluster.alias("cluster")), capacity))
    shards = max(1, -(-d.count() // SHARD_PIECES))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)).cast("long"))

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        source = table["source"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist()
        counts: dict = {}
        raw = table["cluster"].to_pylist()
        for c in raw:
            counts[c] = counts.get(c, 0) + 1
        bit = {c: i for i, c in enumerate(c for c, n in counts.items() if n > 1 and c is not None)}
        bins = best_fit(table["size"].to_pylist(), source, [bit.get(c, -1) for c in raw], capacity, per_source)
        total: dict = {}
        for b, n in zip(bins, table["size"].to_pylist(), strict=True):
            total[b] = total.get(b, 0) + n
        table = table.append_column("bin", pa.array(bins, pa.int64())).append_column("bin_size", pa.array([total[b] for b in bins], pa.int64()))
        return table.select([c.split()[0] for c in SCHEMA.split(", ")])

    return d.groupBy("shard").applyInArrow(shard, SCHEMA)

