"""N-gram Jaccard join by multiple-global-order filtering, as groups of linked documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import join_per_key, small, stash
from alertloom.llm.components import components
from alertloom.llm.tokens import chunks, mixed, word_bounds, word_hashes

#: Words of a shingle and the least Jaccard similarity, in hundredths.
WORDS, SIMILARITY = 4, 85
#: Global token orders whose prefixes candidates must share.
ORDERS = 3
#: Orders whose very first tokens gather documents for a first round of links.
LEADS = 4
#: A token is frequent if it is counted in more documents than this and than total tokens / 2**21: at most 2**21 are, by that bound.
FREQUENT, MOST_FREQUENT = 16, 1 << 21
#: Bits of a parity bitmap for each token, and at least and at most; documents of a tile of postings, and postings of a task.
BITS_PER_TOKEN, LEAST_BITS, MOST_BITS = 1, 256, 8192
TILE, TASK_POSTS = 1024, 4000
#: Tokens sorted at a time while counting; those of fewer documents than LOCAL among them aren't counted.
COUNTED, LOCAL = 3_000_000, 4


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each row, as sorted hashes; of a row with fewer words, its whole sequence as one."""
    starts, ends, first = word_bounds(data, offsets)
    w = word_hashes(data, starts, ends)
    if len(w) >= n:
        joint = mixed(w[: len(w) - n + 1], 101)
        for k in range(1, n):
            joint = mixed(joint + w[k : len(w) - n + 1 + k], 101 + k)
    else:
        joint = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(joint[a : b - n + 1]))
        elif b > a:
            x = np.uint64(b - a)
            one = np.array([x])
            for k in range(a, b):
                one = mixed(one + w[k], 201)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n: int, similarity: int) -> int:
    """Two sets that are similar enough share a token among the first this many of either, in any one order of all tokens."""
    return n + (-similarity * n) // 100 + 1


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bitmap in which each token flips one bit; its length, a power of two, goes with the number of tokens.

    The bits in which two bitmaps differ are at most as many as the tokens in which the sets differ, an exact bound. A bitmap
    folds to half its length by xor of its halves.
    """
    size = LEAST_BITS
    while size < min(MOST_BITS, BITS_PER_TOKEN * len(tokens)):
        size *= 2
    bits = np.bincount((mixed(tokens, 55) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def close_pairs(n: np.ndarray, group: np.ndarray, bits: list[bytes], side: np.ndarray | None, similarity: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of pairs of different groups that size and bitmaps allow to be similar; from side to side if there are two."""
    length = np.array([len(b) for b in bits])
    for size in np.unique(length):
        low = np.flatnonzero(length == size)
        a = np.frombuffer(b"".join(bits[i] for i in low), np.uint64).reshape(len(low), -1)
        high = np.flatnonzero(length == 2 * size)
        b = np.frombuffer(b"".join(bits[i] for i in high), np.uint64).reshape(len(high), -1) if len(high) else np.zeros((0, 2 * a.shape[1]), np.uint64)
        b = b[:, : a.shape[1]] ^ b[:, a.shape[1] :]
        for x, y, own, other, same in ((a, a, low, low, True), (a, b, low, high, False)):
            step = max(1, 4_000_000 // max(1, y.size))
            for at in range(0, len(x) if len(y) else 0, step):
                i, j = own[at : at + step, None], other[None]
                may = (group[i] != group[j]) & (100 * np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
                if same:
                    may &= i < j
                if side is not None:
                    may &= side[i] != side[j]
                r, c = np.nonzero(may)
                for k in range(0, len(r), step_pairs := max(1, 4_000_000 // x.shape[1])):
                    rr, cc = r[k : k + step_pairs], c[k : k + step_pairs]
                    differ = np.bitwise_count(x[at + rr] ^ y[cc]).sum(1, dtype=np.int64)
                    ii, jj = own[at + rr], other[cc]
                    ok = differ * (100 + similarity) <= (n[ii] + n[jj]) * (100 - similarity)
                    yield ii[ok], jj[ok]


def _rows(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            yield batch.slice(lo, hi - lo), shingles(data, offsets, n)


def frequent_tokens(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, class) of the frequent tokens, in order of the token; the class grows with the logarithm of the count.

    Counts come from all documents. A task leaves out what few of the documents that it sorts at a time hold, so counts are lower
    bounds; they only choose the orders, any of which gives the same links.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = total = 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(np.append(tokens[many].view(np.int64), 0)), pa.array(np.append(counts[many], size)), pa.array(np.append(np.zeros(many.sum(), bool), True))], ["token", "n", "all"])

        for _, sets in _rows(batches, n):
            held += sets
            size += sum(map(len, sets))
            if size >= COUNTED:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    counts = texts.select("text").mapInArrow(count, "token long, n long, all boolean").groupBy("token", "all").agg(F.sum("n").alias("n"))
    counts = stash(counts)
    total = counts.filter("all").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counts.filter(~F.col("all") & (F.col("n") > max(FREQUENT, total // MOST_FREQUENT))).toArrow()
    tokens = top["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.minimum(np.log2(top["n"].to_numpy()[order]), 31).astype(np.uint64)


def _jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both, len(a) + len(b) - both


def verify(pairs: DataFrame, texts: DataFrame, n: int, similarity: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar, from the shingles of both whole texts.

    Only the texts of paired documents are shuffled, where their ids are few enough to go to every task.
    """
    pairs = stash(pairs)
    ids = stash(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    text = texts.join(small(ids), "node", "left_semi").select(F.col("node").alias("k"), "text")
    both = pairs.join(text, pairs["b"] == text["k"]).select("a", "b", F.col("text").alias("text_b"))
    both = both.join(text, both["a"] == text["k"]).select("a", "b", F.col("text").alias("text_a"), "text_b")

    def similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
            for a, (_, _, data, offsets) in zip(batch.column("text_a").to_pylist(), ((0, 0, *x[2:]) for i in range(batch.num_rows) for x in chunks(batch.column("text_b").slice(i, 1))), strict=True):
                if a != last[0]:
                    last = (a, shingles(np.frombuffer(a, np.uint8), np.array([0, len(a)]), n)[0])
                inter, union = _jaccard(last[1], shingles(data, offsets, n)[0])
                keep.append(100 * inter >= similarity * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(similar, "a long, b long")


def join(docs: DataFrame, n: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, group_id, text_hash) of every document: its group under the links of Jaccard similarity.

    Words are runs of other than ASCII whitespace, A-Z as a-z. A document of fewer than ``n`` words has its whole sequence as one
    shingle; null, empty and blank texts have none and link with nothing. Rows that repeat a doc_id are grouped one by one, each
    by its own text: ``group_id`` tells their groups apart, which may have one smallest doc_id, and ``text_hash`` (xxhash64) tells the rows
    of other texts apart. Null doc_id counts as one document larger than any other and comes back null. An empty table gives an empty result; other columns are ignored. Shingles are taken as 64-bit hashes.

    1. Documents of equal shingle sets are one representative, the smallest doc_id (``set_id``).
    2. Documents that share the first token under one of LEADS orders get a link, if similar, to the one of them with the fewest
       rare tokens, which is what others were copied from: most groups of copies form here, in a number of pairs that is linear in
       the documents.
    3. Representatives of different groups that share a prefix token under order 1 meet, tile by tile where a token has many. Those
       that their sizes and parity bitmaps allow to be similar, an exact bound, are candidates; of these, those that also share
       prefix tokens under the other orders are verified. In any order similar sets share a prefix token, so no link between
       groups is lost; pairs within a group can't change it and aren't made. Frequent tokens come last in each order, which keeps
       passages that many documents hold out of the prefixes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    tokens, classes = frequent_tokens(texts, n)
    top = spark.sparkContext.broadcast((tokens, classes))
    schema = "doc_id long, text_hash long, n_shingles long, set_hash binary, leads array<long>, prefix array<long>, other array<array<int>>, rare long, bits binary"

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cls = top.value
        for batch, sets in _rows(batches, n):
            hashes, leads, prefixes, others, rare, bits = [], [], [], [], [], []
            for s in sets:
                hashes.append(np.array([len(s), mixed(s, 1).sum(dtype=np.uint64), mixed(s, 2).sum(dtype=np.uint64)], np.uint64).tobytes())
                bits.append(parity(s).tobytes())
                if not len(s):
                    rare.append(0)
                    leads.append([])
                    prefixes.append([])
                    others.append([])
                    continue
                late = np.zeros(len(s), np.uint64)
                if len(known):
                    at = np.searchsorted(known, s).clip(max=len(known) - 1)
                    late = np.where(known[at] == s, cls[at] + np.uint64(1), np.uint64(0)) << np.uint64(58)
                rare.append(int((late == 0).sum()))
                p = prefix_length(len(s), similarity)
                firsts = []
                for k in range(ORDERS):
                    key = late | mixed(s, 11 + k) >> np.uint64(6)
                    firsts.append(s[np.argpartition(key, p - 1)[:p]] if p < len(s) else s)
                prefixes.append(firsts[0].view(np.int64))
                others.append([(mixed(x, 77) >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in firsts[1:]])
                leads.append([int(mixed(s, 31 + k).min().view(np.int64)) for k in range(LEADS)])
            arrays = [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), pa.array(leads, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.list_(pa.int32()))), pa.array(rare, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    described = stash(texts.mapInArrow(describe, schema))
    # a document's node is its doc_id, but for ids of several texts, where it is a hash of both
    torn = stash(described.groupBy(F.col("doc_id").alias("torn")).agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).filter("lo < hi").select("torn"))
    node = F.when(F.col("torn").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text_hash"))
    noded = lambda d: d.join(small(torn), d["doc_id"] == torn["torn"], "left").withColumn("node", node).drop("torn")
    rows = noded(described)
    full = rows.filter("n_shingles > 0")
    reps = stash(full.groupBy("set_hash").agg(F.min(F.struct("doc_id", "node")).alias("rep"), F.count(F.lit(1)).alias("many")))
    own = rows.select("doc_id", "text_hash", "n_shingles", "set_hash", "node")
    members = join_per_key(own.filter("n_shingles > 0"), reps.filter("many > 1").select("set_hash", "rep", "many"), ["set_hash"]).select("doc_id", "text_hash", "n_shingles", "node", F.col("rep.node").alias("rep"), F.col("rep.doc_id").alias("set_id"))
    # sets of one document aren't joined
    members = stash(members)
    copies = stash(members.filter("node <> rep").select("node").distinct())
    sets = full.join(small(copies), "node", "left_anti").drop("doc_id").withColumnRenamed("node", "rep")

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.filter((100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")))

    lead = sets.select("rep", F.col("n_shingles").alias("n"), "rare", F.posexplode("leads").alias("k", "token"))
    first = stash(lead.groupBy("k", "token").agg(F.min(F.struct("rare", "rep", "n")).alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("k", "token", "first", "many"))
    stars = near(join_per_key(lead, first, ["k", "token"]).select(F.col("first.rep").alias("a"), F.col("rep").alias("b"), F.col("first.n").alias("n_a"), F.col("n").alias("n_b"))).filter("a <> b").select("a", "b").distinct()
    texts = noded(texts).select("node", "text")
    links = stash(verify(stars, texts, n, similarity))
    group = components(links)  # a written table

    grouped = sets.join(small(group), sets["rep"] == group["id"], "left").select("rep", F.col("n_shingles").alias("n"), "prefix", "bits", F.coalesce("component", "rep").alias("group"))
    tokens = grouped.select("group", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    tokens = stash(tokens.select(F.col("token").alias("t"), F.ceil(F.col("n") / TILE).alias("tiles"), "n"))
    tasks = max(1, (tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // TASK_POSTS)
    posts = grouped.select("rep", F.explode("prefix").alias("token")).join(small(tokens.drop("n"), 1 << 21), F.col("token") == F.col("t"))
    posts = posts.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    # a small token's postings go with those of others, a large one's tiles by themselves
    posts = posts.select("rep", "token", "tile", F.when(F.col("tiles") == 1, F.pmod("token", F.lit(tasks))).otherwise(F.col("token")).alias("task"), F.least("tile", "o").alias("r"), F.greatest("tile", "o").alias("c"))
    posts = posts.join(grouped.select("rep", "n", "group", "bits"), "rep")

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("token")
        token, rep, n, grp, tile = (t[c].to_numpy() for c in ("token", "rep", "n", "group", "tile"))
        bits = t["bits"].to_pylist()
        cross = t["r"][0] != t["c"][0]
        out = []
        bounds = np.append(np.flatnonzero(np.diff(token, prepend=token[0] - 1 if token[0] > -(2**63) else token[0] + 1)), len(token))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            for i, j in close_pairs(n[lo:hi], grp[lo:hi], bits[lo:hi], tile[lo:hi] if cross else None, similarity) if hi - lo > 1 else ():
                a, b = rep[lo:hi][i], rep[lo:hi][j]
                out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    pairs = posts.groupBy("task", "r", "c").applyInArrow(meet, "a long, b long").distinct()
    pairs = stash(pairs)
    ids = stash(pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct())
    other = sets.select(F.col("rep").alias("k"), "other").join(small(ids), "k", "left_semi")
    pairs = pairs.join(other, pairs["a"] == other["k"]).select("a", "b", F.col("other").alias("other_a"))
    pairs = pairs.join(other, pairs["b"] == other["k"])
    for k in range(ORDERS - 1):
        pairs = pairs.filter(F.arrays_overlap(F.col("other_a")[k], F.col("other")[k]))
    more = stash(verify(pairs.select("a", "b"), texts, n, similarity))
    groups = components(links.unionByName(more))
    # a group's smallest doc_id; nodes are doc_ids where none is torn
    named = groups.select(F.col("id").alias("rep"), F.col("component").alias("group_id"))
    heads = rows.select(F.col("node").alias("rep"), "doc_id").join(named, "rep").groupBy("group_id").agg(F.min("doc_id").alias("component_id"))
    named = stash(named.join(heads, "group_id"))
    out = rows.select("doc_id", "text_hash", "n_shingles", "node").join(members.select("node", "rep", "set_id").distinct(), "node", "left").withColumns({"rep": F.coalesce("rep", "node"), "set_id": F.coalesce("set_id", "doc_id")})
    out = out.join(named, "rep", "left").withColumns({"component_id": F.coalesce("component_id", "set_id"), "group_id": F.coalesce("group_id", "rep")})
    null = lambda c: F.when(F.col(c) < 2**63 - 1, F.col(c)).alias(c)
    return out.select(null("doc_id"), "n_shingles", null("component_id"), null("set_id"), "group_id", "text_hash")
