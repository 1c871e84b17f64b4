"""Line dedup: a sharded minimal perfect hash over the distinct line hashes indexes fingerprint and count arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import SPACE_BYTES, stash

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Code points that a line's key has at least; shorter lines always stay.
MIN_POINTS = 10
#: Distinct or repeated lines of an index shard, on average.
SHARD_LINES = 200_000
MIN_SHARDS = 64
#: Keys found in more lines than total / HOT_KEYS (and HOT_LEAST) are hot: at most HOT_KEYS of them, so that their index, of
#: under 35 bytes a key, has a proven bound and is broadcast.
HOT_KEYS = 65_536
HOT_LEAST = 512
#: Bits of a level of the perfect hash per key that reaches it.
GAMMA = 2.0
MAX_LEVELS = 24
NO_DOC = 2**63 - 1
INDEX = "shard long, bits binary, ranks binary, sizes array<long>, rest_h array<long>, fingerprints binary, counts binary, keepers binary"
LINES = "doc_id long, text_hash long, lines array<struct<pos:int,h:long,f:long,first:boolean>>"


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer; seeds give independent functions."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of 64-bit keys by levels of bit arrays: a key lives at the first level where its bit is its own."""

    def __init__(self, bits: np.ndarray, ranks: np.ndarray, sizes: list[int], rest: np.ndarray) -> None:
        self.bits, self.ranks, self.sizes, self.rest = bits, ranks, sizes, rest

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(keys) and len(sizes) < MAX_LEVELS:
            size = max(64, (int(GAMMA * len(keys)) + 63) // 64 * 64)
            at = (mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            sizes.append(size)
            parts.append(hits == 1)
            keys = keys[hits[at] > 1]
        bits = np.packbits(np.concatenate(parts), bitorder="little").view(np.uint64) if parts else np.zeros(0, np.uint64)
        ones = np.bitwise_count(bits).astype(np.uint32)
        return cls(bits, np.cumsum(ones, dtype=np.uint32) - ones, sizes, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; of a key that was not built in, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = base + (mixed(keys[todo], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.bits[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            here = (word & bit) != 0
            out[todo[here]] = self.ranks[at[here] >> 6] + np.bitwise_count(word[here] & (bit[here] - np.uint64(1)))
            todo, base = todo[~here], base + size
        if len(todo) and len(self.rest):
            placed = int(self.ranks[-1]) + int(np.bitwise_count(self.bits[-1])) if len(self.bits) else 0
            at = np.searchsorted(self.rest, keys[todo]).clip(max=len(self.rest) - 1)
            known = self.rest[at] == keys[todo]
            out[todo[known]] = placed + at[known]
        return out


class LineIndex:
    """Arrays of one shard by slot, asked only for lines that it was built from: 32-bit fingerprint, document count (up to 255), and for counts over 1 the keeping document."""

    def __init__(self, phf: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> None:
        self.phf, self.fingerprints, self.counts, self.keepers = phf, fingerprints, counts, keepers
        self.keeper_at = np.cumsum(counts > 1) - 1

    @classmethod
    def build(cls, h: np.ndarray, f: np.ndarray, docs: np.ndarray, keepers: np.ndarray) -> LineIndex:
        keys = joined(h, f)
        phf = PerfectHash.build(keys)
        at = phf.slots(keys)
        fp, counts, keep = np.zeros(len(h), np.uint32), np.zeros(len(h), np.uint8), np.zeros(len(h), np.int64)
        fp[at], counts[at], keep[at] = f, np.minimum(docs, 255), keepers
        return cls(phf, fp, counts, keep[counts > 1])

    def row(self, shard: int) -> list:
        p = self.phf
        return [shard, p.bits.tobytes(), p.ranks.tobytes(), p.sizes, p.rest.view(np.int64).tolist(), self.fingerprints.tobytes(), self.counts.tobytes(), self.keepers.tobytes()]

    @classmethod
    def of(cls, row: dict) -> LineIndex:
        phf = PerfectHash(np.frombuffer(row["bits"], np.uint64), np.frombuffer(row["ranks"], np.uint32), row["sizes"], np.array(row["rest_h"], np.int64).view(np.uint64))
        return cls(phf, np.frombuffer(row["fingerprints"], np.uint32), np.frombuffer(row["counts"], np.uint8), np.frombuffer(row["keepers"], np.int64))

    def probe(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, keeper) of each line; count 0 where the fingerprint at its slot is another's."""
        at = self.phf.slots(joined(h, f))
        count = np.zeros(len(h), np.int64)
        ok = at >= 0
        ok[ok] = self.fingerprints[at[ok]] == f[ok].astype(np.uint32)
        count[ok] = self.counts[at[ok]]
        keeper = np.full(len(h), NO_DOC, np.int64)
        many = count > 1
        keeper[many] = self.keepers[self.keeper_at[at[many]]]
        return count, keeper


class HotIndex:
    """A line index that strangers may ask: it holds the hashes too, so that all 96 bits of a line must agree."""

    def __init__(self, index: LineIndex, h: np.ndarray, f: np.ndarray) -> None:
        self.index, self.h = index, np.zeros(len(h), np.int64)
        self.h[index.phf.slots(joined(h, f))] = h

    def probe(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, keeper) of each line; count 0 where it isn't in the index."""
        count, keeper = self.index.probe(h, f)
        at = self.index.phf.slots(joined(h, f))
        own = (at >= 0) & (count > 0)
        own[own] = self.h[at[own]] == h[own]
        return np.where(own, count, 0), np.where(own, keeper, NO_DOC)


def joined(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    return h.astype(np.int64).view(np.uint64) + f.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def keys_of(text: bytes) -> tuple[list[int], bytes]:
    """Positions of the lines with a key, and their 16-byte hashes joined."""
    pos, out = [], []
    for i, line in enumerate(text.translate(LOWER).split(b"\n")):
        key = line.strip(SPACE_BYTES)
        if len(key) >= 4 * MIN_POINTS or len(key) >= MIN_POINTS and len(key.decode("utf-8", "replace")) >= MIN_POINTS:
            pos.append(i)
            out.append(xxhash.xxh3_128_digest(key))
    return pos, b"".join(out)


def _hash_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        pos, hashes, sizes = [], [], []
        for t in texts:
            p, h = keys_of(t)
            pos += p
            hashes.append(h)
            sizes.append(len(p))
        pair = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
        h, f = pair[:, 0].view(np.int64) if len(pair) else np.zeros(0, np.int64), (pair[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        first = np.zeros(len(h), bool)
        if len(h):
            order = np.lexsort((np.arange(len(h)), f, h, row))
            same = np.zeros(len(h), bool)
            same[1:] = (h[order][1:] == h[order][:-1]) & (f[order][1:] == f[order][:-1]) & (row[order][1:] == row[order][:-1])
            first[order] = ~same
        struct = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(h), pa.array(f), pa.array(first)], ["pos", "h", "f", "first"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), struct)
        text_hash = pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text_hash, lists], ["doc_id", "text_hash", "lines"])


def _index_of(keys: pa.Table) -> LineIndex:
    get = lambda c: keys[c].to_numpy()
    return LineIndex.build(get("h"), get("f"), np.where(get("lo") < get("hi"), np.maximum(get("n"), 2), 1), get("lo"))


def _build(table: pa.Table) -> pa.Table:
    index = _index_of(table)
    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([v], t) for v, t in zip(index.row(table["shard"][0].as_py()), types, strict=True)], names=names)


DROPS = "doc_id long, text_hash long, pos int"


def _dropped(index: LineIndex | HotIndex, table: pa.Table) -> pa.Table:
    """The lines of ``table`` that other, smaller documents keep."""
    _, keeper = index.probe(table["h"].to_numpy(), table["f"].to_numpy())
    mine = table["doc_id"].fill_null(NO_DOC).to_numpy()
    return table.select(["doc_id", "text_hash", "pos"]).filter(pa.array(keeper < mine))


def _rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, texts = [], [], []
        for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            text = text or b""
            if drop:
                lines, gone = text.split(b"\n"), set(drop)
                n_lines.append(len(lines))
                text = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
            else:
                n_lines.append(text.count(b"\n") + 1)
            n_dropped.append(len(drop or ()))
            texts.append(text)
        sha = pa.array([hashlib.sha256(t).hexdigest() for t in texts])
        kept = pa.array(texts, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), kept, sha, *[batch.column(c) for c in batch.schema.names if c not in ("doc_id", "text", "drop")]], ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256", *[c for c in batch.schema.names if c not in ("doc_id", "text", "drop")]])


def build_index(hashes: DataFrame) -> tuple[DataFrame, int, Broadcast, int]:
    """(table of shard indexes, number of shards, index of the hot keys, the least count of a hot key)."""
    spark = hashes.sparkSession
    lines = hashes.select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc"), F.explode("lines").alias("x"))
    keys = lines.groupBy("x.h", "x.f").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.sum(F.col("x.first").cast("long")).alias("n"), F.count(F.lit(1)).alias("lines"))
    keys = stash(keys)
    distinct, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("lines"), F.lit(0))).first()
    least = max(HOT_LEAST, total // HOT_KEYS + 1)
    n_shards = max(MIN_SHARDS, total // SHARD_LINES + 1)
    hot = keys.filter(F.col("lines") >= least).toArrow()
    hot_index = HotIndex(_index_of(hot), hot["h"].to_numpy(), hot["f"].to_numpy())
    index = keys.select(F.pmod("h", F.lit(n_shards)).alias("shard"), "h", "f", "lo", "hi", "n").groupBy("shard").applyInArrow(_build, INDEX)
    return stash(index), n_shards, spark.sparkContext.broadcast(hot_index), least


def dedup(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines that a smaller document holds too.

    Text is split at \\n; null and empty texts are one empty line. Keys, strips and the rule are those of the contract: keys of at
    least MIN_POINTS code points found in two documents lose all their lines but those of the smallest doc_id. Repeats within that
    document stay. Rows of one doc_id are one document; a null doc_id counts as one document larger than any other. An empty table
    gives an empty result; other columns are ignored, but for those named in ``keep``, which come back at the end.
    Keys are taken as 96-bit hashes of the lines. Returns doc_id, n_lines, n_dropped, kept_text, kept_sha256.

    The table of distinct keys is combined before its shuffle. The index has a shard for each SHARD_LINES lines. Lines of hot keys
    are answered where the document is, from a broadcast index of bounded size; other lines go to their shard, a key in at most
    total / HOT_KEYS of them.
    """
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *keep)
    hashes = stash(raw.select("doc_id", "text").mapInArrow(_hash_lines, LINES))
    index, n_shards, hot, _ = build_index(hashes)

    def split_hot(batches: Iterable[pa.RecordBatch], want_hot: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            count, _ = hot.value.probe(t["h"].to_numpy(), t["f"].to_numpy())
            if want_hot:
                yield from _dropped(hot.value, t.filter(pa.array(count > 0))).to_batches()
            else:
                yield from t.filter(pa.array(count == 0)).to_batches()

    lines = hashes.select("doc_id", "text_hash", F.explode("lines").alias("x")).select("doc_id", "text_hash", "x.pos", "x.h", "x.f")
    hot_drops = lines.mapInArrow(lambda b: split_hot(b, True), DROPS)
    cold = lines.mapInArrow(lambda b: split_hot(b, False), DROPS + ", h long, f long").withColumn("shard", F.pmod("h", F.lit(n_shards)))

    def probe(index_rows: pa.Table, lines: pa.Table) -> pa.Table:
        if not index_rows.num_rows:
            return lines.select(["doc_id", "text_hash", "pos"]).slice(0, 0)
        return _dropped(LineIndex.of(index_rows.to_pylist()[0]), lines)

    cold_drops = index.groupBy("shard").cogroup(cold.groupBy("shard")).applyInArrow(probe, DROPS)
    drops = hot_drops.unionByName(cold_drops).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop")).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    # the text's hash comes from the same pass that the positions come from
    tagged = raw.mapInArrow(_tag, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in raw.schema] + ["text_hash long"]))
    whole = tagged.join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select("doc_id", "text", "drop", *keep)
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in raw.schema if f.name in keep)
    return whole.mapInArrow(_rebuild, "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string" + extra)


def _tag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h)], [*batch.schema.names, "text_hash"])
