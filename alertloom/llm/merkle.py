"""Merkle manifest of a dataset: a leaf for each row, a tree for each language, one root over the languages' roots.

Leaves get their places without sorting them: the doc_ids of a language form bitmaps of 4,096 ids, built by each task for its own
rows, merged by bitmap and kept as sorted short integers or as bits with counts of ones every 64 bits; prefix sums over the bitmaps
give each its start, and a rank query in one bitmap gives a leaf its place. Then arrays of 1,024 slots, keyed by language and block,
reduce ten levels at a time; the way back down joins each block's siblings above to those inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.common import join_per_key, stash, unstash

#: Ids of a bitmap and leaves of a slot array, as powers of two.
ID_BITS, BLOCK_BITS = 12, 10
BLOCK = 1 << BLOCK_BITS
#: A bitmap of fewer ids is kept as sorted 16-bit integers.
SPARSE = (1 << ID_BITS) // 16
#: Bucket of null ids, before all others.
NULL_BUCKET = -(1 << 62)
#: Copies of one row that a task lays out.
COPIES = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(values: list[Column]) -> Column:
    """SHA-256 of the fields, each "-" if null, else its UTF-8 byte count, ":" and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, bad) of each row: g is the language ("" for null, else "=" and the language), bad the leaf of the tampered row."""
    chars = F.col("n_chars").cast("decimal(20,0)")
    struck = (F.crc32(F.col("doc_id").cast("long").cast("string")) % 7 == 0) & chars.isNotNull()
    own = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), chars, F.col("text")]
    tampered = F.when(struck, _leaf([*own[:3], (chars + 1).cast("decimal(20,0)"), own[4]]))
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("g"), own[0].alias("doc_id"), _leaf(own).alias("leaf"), tampered.alias("bad"))


def prefix_sums(table: DataFrame, group: list[str], order: list[str], weight: str) -> DataFrame:
    """``table`` (without nulls in its keys) with ``start``, the sum of ``weight`` over the rows before in its group, and ``n``, the
    group's sum. Rows are dealt by ranges, so a group of any size is spread over tasks; what the tasks' sums need is one row a task."""
    dealt = stash(table.repartitionByRange(*group, *order).withColumn("pid", F.spark_partition_id()))
    each = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy(*group, "pid").agg(F.sum(weight).alias("s"))
    sums = sums.select(*group, "pid", (F.sum("s").over(each) - F.col("s")).alias("base"), F.sum("s").over(Window.partitionBy(*group)).alias("n"))
    inner = Window.partitionBy(*group, "pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("inner", F.sum(weight).over(inner) - F.col(weight))
    return placed.join(sums, [*group, "pid"]).select(*table.columns, (F.col("base") + F.col("inner")).alias("start"), "n")


# Bitmaps. A body is the sorted low bits as 16-bit integers, or all bits; counts holds the rows of each id in order unless all have one.


def _packed(low: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes | None]:
    counts = None if (n == 1).all() else n.astype("<u8").tobytes()
    if len(low) < SPARSE:
        return low.astype("<u2").tobytes(), counts
    bits = np.zeros(1 << ID_BITS, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes(), counts


def _unpacked(body: bytes, counts: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if len(body) == 1 << (ID_BITS - 3):
        low = np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little"))
    else:
        low = np.frombuffer(body, "<u2").astype(np.int64)
    return low, np.ones(len(low), np.int64) if counts is None else np.frombuffer(counts, "<u8").astype(np.int64)


BITMAP = "g string, bucket long, body binary, counts binary, total long"


def _bitmap_rows(rows: list[tuple]) -> pa.Table:
    g, bucket, body, counts, total = zip(*rows, strict=True) if rows else ((),) * 5
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip({"g": g, "bucket": bucket, "body": body, "counts": counts, "total": total}.items(), kinds, strict=True)})


def _bitmaps_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmaps of each batch's own ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names, codes = np.unique(np.array(batch.column("g").to_pylist(), dtype=object), return_inverse=True)
        bucket, low, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "low", "n"))
        order = np.lexsort((low, bucket, codes))
        codes, bucket, low, n = codes[order], bucket[order], low[order], n[order]
        cuts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (bucket[1:] != bucket[:-1])))
        rows = [(names[codes[a]], int(bucket[a]), *_packed(low[a:b], n[a:b]), int(n[a:b].sum())) for a, b in zip(cuts, [*cuts[1:], len(codes)], strict=True)]
        yield from _bitmap_rows(rows).to_batches()


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """The bitmaps of one bucket as one; no id is in two of them."""
    parts = [_unpacked(b, c) for b, c in zip(table["body"].to_pylist(), table["counts"].to_pylist(), strict=True)]
    low, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(low)
    return _bitmap_rows([(key[0].as_py(), key[1].as_py(), *_packed(low[order], n[order]), int(n.sum()))])


class Ranks:
    """Rank queries on one bitmap: rows of smaller ids, through counts of ones before each 64 bits."""

    def __init__(self, body: bytes, counts: bytes | None):
        self.low, rows = None, None
        if len(body) == 1 << (ID_BITS - 3):
            self.bits = np.frombuffer(body, "<u8")
            self.ones = np.append(0, np.cumsum(np.bitwise_count(self.bits), dtype=np.int64))
        else:
            self.low = np.frombuffer(body, "<u2")
        if counts is not None:
            rows = np.append(0, np.cumsum(np.frombuffer(counts, "<u8").astype(np.int64)))
        self.rows = rows

    def __call__(self, low: np.ndarray) -> np.ndarray:
        if self.low is not None:
            at = np.searchsorted(self.low, low.astype(np.uint16))
        else:
            word, bit = low >> 6, (low & 63).astype(np.uint64)
            at = self.ones[word] + np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return at if self.rows is None else self.rows[at]


def _placed(key: tuple, ids: pa.Table, bitmap: pa.Table) -> pa.Table:
    rank = Ranks(bitmap["body"][0].as_py(), bitmap["counts"][0].as_py())(ids["low"].to_numpy()) if ids.num_rows else np.zeros(0, np.int64)
    start = bitmap["start"][0].as_py() if bitmap.num_rows else 0
    total = bitmap["n"][0].as_py() if bitmap.num_rows else 0
    return ids.select(["g", "doc_id", "leaf", "bad", "tied", "copies"]).append_column("idx", pa.array(rank.astype(np.int64) + start)).append_column("n", pa.array(np.full(ids.num_rows, total, np.int64)))


SLOT = "g string, doc_id long, leaf binary, bad binary, tied boolean, copies long, idx long, n long"


def slots(rows: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, bad, idx, n) of each of ``rows`` (a written table of leaves): its place among the n leaves of its language."""
    ids = rows.groupBy("g", "doc_id").agg(F.count("*").alias("copies"), F.min(F.struct("leaf", "bad")).alias("lo"), F.max("leaf").alias("hi"))
    mask = (1 << ID_BITS) - 1
    ids = stash(
        ids.select(
            "g", "doc_id", "copies", F.col("lo.leaf").alias("leaf"), F.col("lo.bad").alias("bad"), (F.col("lo.leaf") != F.col("hi")).alias("tied"),
            F.coalesce(F.shiftright("doc_id", ID_BITS), F.lit(NULL_BUCKET)).alias("bucket"), F.coalesce(F.col("doc_id").bitwiseAND(mask), F.lit(0)).cast("long").alias("low"),
        )
    )
    pieces = ids.select("g", "bucket", "low", F.col("copies").alias("n")).mapInArrow(_bitmaps_of_task, BITMAP)
    bitmaps = pieces.groupBy("g", "bucket").applyInArrow(_merged, BITMAP)
    bitmaps = prefix_sums(bitmaps, ["g"], ["bucket"], "total")
    placed = stash(ids.groupBy("g", "bucket").cogroup(bitmaps.groupBy("g", "bucket")).applyInArrow(_placed, SLOT))
    out = placed.filter("not tied")
    tied = placed.filter("tied")
    if tied.limit(1).count():
        out = out.unionByName(_among_ties(rows, tied))
    # A row of many copies is laid out by many tasks.
    many = out.filter(F.col("copies") > COPIES).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("copies") - 1).cast("long"), F.lit(COPIES).cast("long"))))
    many = many.repartition("g", "doc_id", "run").withColumns({"idx": F.col("idx") + F.col("run"), "copies": F.least(F.col("copies") - F.col("run"), F.lit(COPIES))}).drop("run")
    some = out.filter(F.col("copies") <= COPIES)
    if out.filter(F.col("copies") > COPIES).limit(1).count():
        some = some.unionByName(many)
    some = some.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    done = stash(some.select("g", "doc_id", "leaf", "bad", (F.col("idx") + F.col("i")).alias("idx"), "n"))
    unstash(ids)
    unstash(placed)
    return done


def _among_ties(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """Rows of ids that have several different leaves, ordered by leaf inside of the id."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    table = stash(tied.select("g", name, F.col("idx").alias("first"), "copies", F.col("n").alias("of")))
    apart = rows.groupBy("g", name, "doc_id", "leaf", "bad").agg(F.count("*").alias("m"))
    found = join_per_key(apart, table, ["g", "name"], "copies").drop("copies")
    found = prefix_sums(found, ["g", "name"], ["leaf"], "m")
    return found.select("g", "doc_id", "leaf", "bad", F.lit(True).alias("tied"), F.col("m").alias("copies"), (F.col("first") + F.col("start")).alias("idx"), F.col("of").alias("n"))


# The tree. Digests move as 32 bytes and are hashed as hex text.


def _h(parts: bytes) -> bytes:
    return hashlib.sha256(parts).hexdigest().encode()


def _levels(slot: list[bytes], n: int) -> list[list[bytes]]:
    """The nodes of one block, level by level, up to its one node: all levels of a block if there are others, else until one is left."""
    out = [slot]
    for _ in range(BLOCK_BITS):
        if n <= BLOCK and len(slot) == 1:
            break
        slot = [_h(b"".join(slot[i : i + 2])) for i in range(0, len(slot), 2)]
        out.append(slot)
    return out


def _slot_array(table: pa.Table) -> tuple[np.ndarray, list[bytes], int]:
    """(order of the rows, nodes in their slots, nodes of the group) of one block."""
    order = np.argsort(table["idx"].to_numpy())
    digests = table["leaf"].take(pa.array(order)).to_pylist()
    return order, [d.hex().encode() for d in digests], table["n"][0].as_py()


NODE = "g string, idx long, n long, leaf binary"


def _top(key: tuple, table: pa.Table) -> pa.Table:
    _, slot, n = _slot_array(table)
    node = bytes.fromhex(_levels(slot, n)[-1][0].decode())
    return pa.table({"g": pa.array([key[0].as_py()], pa.string()), "idx": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "leaf": pa.array([node], pa.binary())})


def _block() -> Column:
    return F.shiftright("idx", BLOCK_BITS).alias("block")


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Written tables of the nodes, ten levels apart, up to one node a group; at least one above ``nodes``."""
    out = []
    while True:
        nodes = stash(nodes.groupBy("g", _block()).applyInArrow(_top, NODE))
        out.append(nodes)
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return out


def _inner(slot: list[bytes], n: int) -> list[tuple[bytes, str]]:
    """For each slot, the siblings inside of its block as joined digests, and their sides: L, R, or - where there is none."""
    levels, out = _levels(slot, n), []
    for i in range(len(slot)):
        found, sides = [], []
        for level in levels[:-1]:
            j = i ^ 1
            sides.append("-" if j >= len(level) else "L" if j < i else "R")
            if j < len(level):
                found.append(level[j])
            i >>= 1
        out.append((bytes.fromhex(b"".join(found).decode()), "".join(sides)))
    return out


PATH = "g string, block long, siblings binary, sides string, sub binary, root binary"


def _paths(own_root: bool):
    """Paths of the nodes of a block: inside of it, then those of the block itself. ``own_root``: nodes are roots of languages."""

    def paths(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        if not nodes.num_rows or not above.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(("g", "block", "siblings", "sides", "sub", "root"), (pa.string(), pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.binary()), strict=True)})
        order, slot, n = _slot_array(nodes)
        outer, sides, sub, root = (above[c][0].as_py() for c in ("siblings", "sides", "sub", "root"))
        found = _inner(slot, n)
        names = nodes["child" if own_root else "g"].take(pa.array(order)).to_pylist()
        where = [0] * len(slot) if own_root else nodes["idx"].take(pa.array(order)).to_pylist()
        subs = [bytes.fromhex(d.decode()) for d in slot] if own_root else [sub] * len(slot)
        return pa.table(
            {
                "g": pa.array(names, pa.string()), "block": pa.array(where, pa.int64()), "siblings": pa.array([a + outer for a, _ in found], pa.binary()),
                "sides": pa.array([b + sides for _, b in found], pa.string()), "sub": pa.array(subs, pa.binary()), "root": pa.array([root] * len(slot), pa.binary()),
            }
        )

    return paths


def fold(leaf: bytes, siblings: list[bytes], sides: str) -> bytes:
    """The root that a leaf's hex digest leads to through its siblings' hex digests."""
    at = iter(siblings)
    for side in sides:
        leaf = _h(next(at) + leaf if side == "L" else leaf + next(at) if side == "R" else leaf)
    return leaf


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    order, slot, n = _slot_array(nodes)
    outer, outer_sides, sub, root = (above[c][0].as_py() for c in ("siblings", "sides", "sub", "root"))
    outer, sub, root = outer.hex().encode(), sub.hex(), root.hex()
    bad = nodes["bad"].take(pa.array(order)).to_pylist()
    proofs, folded = [], []
    for i, (own, sides) in enumerate(_inner(slot, n)):
        joined = own.hex().encode() + outer
        proofs.append(_h(joined).decode())
        folded.append(fold(bad[i].hex().encode() if bad[i] is not None else slot[i], [joined[k : k + 64] for k in range(0, len(joined), 64)], sides + outer_sides).decode())
    size = len(slot)
    return pa.table(
        {
            "doc_id": nodes["doc_id"].take(pa.array(order)), "leaf": pa.array([d.decode() for d in slot], pa.string()), "subroot": pa.array([sub] * size, pa.string()), "root": pa.array([root] * size, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_()),
        }
    )


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    folded_root is recomputed from the row's leaf, or the tampered one's where the row counts as tampered with, through its siblings.
    Rows of null doc_id come first in their language and are never tampered with; rows that share a language and doc_id are ordered by
    leaf; equal rows have a leaf and a place each. A null language is one of its own. An empty table gives no rows. Other columns
    aren't read. n_chars counts as a whole number.
    """
    rows = stash(leaves(docs))
    base = slots(rows)
    unstash(rows)
    up = _climb(base.select("g", "idx", "n", "leaf"))
    tops = up[-1].select(F.lit("").alias("all"), F.col("g").alias("child"), "leaf", F.lit(1).cast("long").alias("one"))
    langs = stash(prefix_sums(tops, ["all"], ["child"], "one").select(F.col("all").alias("g"), "child", F.col("start").alias("idx"), "n", "leaf"))
    over = _climb(langs.select("g", "idx", "n", "leaf"))
    none, text = F.lit(b"").cast("binary"), F.lit("")
    above = over[-1].select("g", F.col("idx").alias("block"), none.alias("siblings"), text.alias("sides"), none.alias("sub"), F.col("leaf").alias("root"))
    for nodes, own in [*[(t, False) for t in over[-2::-1]], (langs, True), *[(t, False) for t in up[-2::-1]]]:
        above = stash(nodes.groupBy("g", _block()).cogroup(above.groupBy("g", "block")).applyInArrow(_paths(own), PATH))
    return base.groupBy("g", _block()).cogroup(above.groupBy("g", "block")).applyInArrow(_proofs, PROOF)
