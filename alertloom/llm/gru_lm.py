"""LM scoring: a gated recurrent language model with a class-factored softmax, trained and run in numpy inside Spark tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import stash
from alertloom.llm.tokens import chunks, word_bounds, word_hashes

#: Hash of the token that ends every document.
END = 0x5DEECE66D
#: Words that the network predicts itself, by count; others share one output and go by their counts.
CLASSES, PER_CLASS = 32, 32
VOCAB = CLASSES * PER_CLASS - 1
#: Most frequent words whose counts tasks hold: a bounded table; other words' counts come by a join.
TOP_WORDS = 1 << 17
HIDDEN = 12
#: Bound of a weight: 12 of them and a bias stay within what a 32-bit exponential holds.
LARGEST = 5.0
#: Words of a window of truncated backpropagation, texts side by side, step sizes of the first fit and of the tasks' passes.
WINDOW, LANES, FIRST_STEP, STEP = 16, 512, 0.01, 0.004
#: Documents of the first fit at most, and windows' batches it takes from them.
FIRST_DOCS, FIRST_BATCHES = 2000, 400
#: Tokens held at a time by a task.
BLOCK_TOKENS = 3_000_000
NAMES = ("emb", "wx", "wh", "b", "cls", "cls_b", "out", "out_b")


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of the id as text is 2 modulo 7; a null id is the text ''."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def new_model(seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    g = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(np.float32)
    h = HIDDEN
    return {"emb": g(VOCAB + 1, h), "wx": g(h, 3 * h, k=0.2), "wh": g(h, 3 * h, k=0.2), "b": np.zeros(3 * h, np.float32), "cls": g(h, CLASSES), "cls_b": np.zeros(CLASSES, np.float32), "out": g(CLASSES, h, PER_CLASS), "out_b": np.zeros((CLASSES, PER_CLASS), np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(x, -40, 40, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def forward(m: dict[str, np.ndarray], table: np.ndarray, ids: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """(states before each token's successor (T, hidden, lanes), last state, what backpropagation needs) of a window of inputs.

    ``table`` holds the input's share of the gates for each word. After an end token, 0, the state is blank: a new document.
    Lanes are the last axis, so that each gate is one stretch of memory.
    """
    n = HIDDEN
    xs = np.ascontiguousarray(table.take(ids.ravel(), 0).reshape(*ids.shape, 3 * n).transpose(0, 2, 1))
    out = np.empty((len(ids), n, ids.shape[1]), np.float32)
    kept = []
    blank = ids == 0
    ends = blank.any(1)
    wht = np.ascontiguousarray(m["wh"].T)
    for t in range(len(ids)):
        if ends[t]:
            h = h.copy()
            h[:, blank[t]] = 0
        hw = wht @ h
        g = xs[t, : 2 * n]
        g += hw[: 2 * n]
        sigmoid(g)
        r, z = g[:n], g[n:]
        c, hc = xs[t, 2 * n :], hw[2 * n :]
        c += r * hc
        # tanh(c) = 2 sigmoid(2 c) - 1
        c += c
        sigmoid(c)
        c += c
        c -= 1
        new = out[t]
        np.subtract(h, c, out=new)
        new *= z
        new += c
        if keep:
            kept.append((h, r, z, c, hc))
        h = new
    return out, h.copy(), kept


def rows(states: np.ndarray) -> np.ndarray:
    """States as (tokens, hidden)."""
    return states.transpose(0, 2, 1).reshape(-1, HIDDEN)


def gates(m: dict[str, np.ndarray]) -> np.ndarray:
    return m["emb"] @ m["wx"] + m["b"]


def by_class(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(class, positions) of the targets."""
    c = (target // PER_CLASS).astype(np.int16)
    order = np.argsort(c, kind="stable")
    bounds = np.searchsorted(c[order], np.arange(CLASSES + 1))
    for k in range(CLASSES):
        if bounds[k] < bounds[k + 1]:
            yield k, order[bounds[k] : bounds[k + 1]]


def log_prob(m: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target given its state: that of its class times that in its class.

    States are below 1 and weights are held below LARGEST, so the exponentials can't overflow.
    """
    x = h @ m["cls"] + m["cls_b"]
    out = x[np.arange(len(target)), target // PER_CLASS]
    out -= np.log(np.exp(x, out=x).sum(1))
    for k, at in by_class(target):
        x = h.take(at, 0) @ m["out"][k] + m["out_b"][k]
        y = x[np.arange(len(at)), target[at] % PER_CLASS]
        out[at] += y - np.log(np.exp(x, out=x).sum(1))
    return out


def _softmax_error(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    x[np.arange(len(y)), y] -= 1
    return x


def gradients(m: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, h0: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(gradients of the mean log loss, last state) over one window."""
    n = HIDDEN
    states, last, kept = forward(m, gates(m), inputs, h0, keep=True)
    h, y = rows(states), targets.ravel()
    g = {"out": np.zeros_like(m["out"]), "out_b": np.zeros_like(m["out_b"]), "wh": np.zeros_like(m["wh"]), "emb": np.zeros_like(m["emb"])}
    share = np.float32(1 / max(len(y), 1))
    p = _softmax_error(h @ m["cls"] + m["cls_b"], y // PER_CLASS)
    g["cls"], g["cls_b"] = h.T @ p * share, p.sum(0) * share
    dstates = p @ m["cls"].T
    for k, at in by_class(y):
        hk = h.take(at, 0)
        q = _softmax_error(hk @ m["out"][k] + m["out_b"][k], y[at] % PER_CLASS)
        g["out"][k], g["out_b"][k] = hk.T @ q * share, q.sum(0) * share
        dstates[at] += q @ m["out"][k].T
    dstates *= share
    dstates = np.ascontiguousarray(dstates.reshape(*inputs.shape, n).transpose(0, 2, 1))
    lanes = inputs.shape[1]
    dx = np.empty((len(inputs), 3 * n, lanes), np.float32)
    dh = np.zeros((n, lanes), np.float32)
    dhw = np.empty((3 * n, lanes), np.float32)
    blank = inputs == 0
    ends = blank.any(1)
    for t in range(len(inputs) - 1, -1, -1):
        before, r, z, c, hc = kept[t]
        dh += dstates[t]
        d = dx[t]
        dr, dz, dc = d[:n], d[n : 2 * n], d[2 * n :]
        np.subtract(1, z, out=dc)
        np.multiply(dc, z, out=dz)
        dz *= dh
        dz *= before - c
        dc *= dh
        dc *= 1 - c * c
        np.multiply(dc, r, out=dhw[2 * n :])
        np.multiply(dhw[2 * n :], 1 - r, out=dr)
        dr *= hc
        dhw[: 2 * n] = d[: 2 * n]
        g["wh"] += before @ dhw.T
        dh *= z
        dh += m["wh"] @ dhw
        if ends[t]:
            dh[:, blank[t]] = 0
    flat, ids = dx.transpose(0, 2, 1).reshape(-1, 3 * n), inputs.ravel()
    order = np.argsort(ids.astype(np.int16), kind="stable")
    heads = np.flatnonzero(np.diff(ids[order], prepend=-1))
    per = np.zeros((len(m["emb"]), 3 * n), np.float32)
    per[ids[order][heads]] = np.add.reduceat(flat.take(order, 0), heads)
    g["wx"], g["b"], g["emb"] = m["emb"].T @ per, per.sum(0), per @ m["wx"].T
    return g, last


class Adam:
    """Adam with clipped gradients and bounded weights."""

    def __init__(self, m: dict[str, np.ndarray], step: float) -> None:
        self.m, self.step, self.t = m, step, 0
        self.a = {k: np.zeros_like(v) for k, v in m.items()}
        self.b = {k: np.zeros_like(v) for k, v in m.items()}

    def update(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float(np.vdot(v, v)) for v in g.values())))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        rate = float(self.step * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t))
        for k, v in g.items():
            a, b = self.a[k], self.b[k]
            v *= scale
            a += 0.1 * (v - a)
            v *= v
            b += 0.001 * (v - b)
            np.sqrt(b, out=v)
            v += 1e-8
            np.divide(a, v, out=v)
            v *= rate
            self.m[k] -= v
            np.clip(self.m[k], -LARGEST, LARGEST, out=self.m[k])


def lanes_of(docs: list[np.ndarray], lanes: int = LANES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(inputs, targets) windows of documents laid end to end in lanes; every token is a target once.

    The first lanes are a token longer where lengths can't be equal, so the last window may have them alone. A lane that starts
    inside a document starts with a blank state.
    """
    if not docs:
        return
    stream = np.concatenate(docs)
    lanes = max(1, min(lanes, len(stream) // WINDOW))
    width, longer = divmod(len(stream), lanes)
    cut = longer * (width + 1)
    first = stream[:cut].reshape(longer, width + 1).T
    grid = np.concatenate([first[:width], stream[cut:].reshape(lanes - longer, width).T], 1)
    start = np.zeros(lanes, stream.dtype)
    for t in range(0, width, WINDOW):
        y = grid[t : t + WINDOW]
        x = np.concatenate([(grid[t - 1] if t else start)[None], y[:-1]])
        yield x, y
    if longer:
        yield first[width - 1 : width], first[width:]


def train_on(m: dict[str, np.ndarray], blocks: Iterable[list[np.ndarray]], step: float, limit: int | None = None) -> tuple[dict[str, np.ndarray], int]:
    """One pass over the documents by truncated backpropagation; states go on from window to window."""
    adam, seen, done = Adam(m, step), 0, 0
    for docs in blocks:
        h = None
        for x, y in lanes_of(docs):
            h = np.zeros((HIDDEN, x.shape[1]), np.float32) if h is None else h[:, : x.shape[1]]
            g, h = gradients(m, x, y, h)
            adam.update(g)
            seen += y.size
            done += 1
            if limit and done >= limit:
                return m, seen
    return m, seen


def score_documents(m: dict[str, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Sum over each document's tokens of the log probability (natural), state carried from its first token to its last.

    Longest first, so that those still running are the first lanes; the input before the first token is the end token, 0.
    """
    sizes = np.array([len(d) for d in docs])
    out = np.zeros(len(docs))
    order = np.argsort(-sizes, kind="stable")
    table = gates(m)
    for some in [order] if len(docs) else []:
        n = sizes[some]
        at = np.concatenate([[0], np.cumsum(n)])[:-1]
        flat = np.concatenate([docs[i] for i in some])
        h = np.zeros((HIDDEN, len(some)), np.float32)
        prev = np.zeros(len(some), flat.dtype)
        for t in range(0, int(n[0]), WINDOW):
            live = int(np.searchsorted(-n, -t, "left"))
            pos = at[:live] + t + np.arange(WINDOW)[:, None]
            there = t + np.arange(WINDOW)[:, None] < n[:live]
            y = np.where(there, flat[np.minimum(pos, len(flat) - 1)], 0)
            x = np.concatenate([prev[None, :live], y[:-1]])
            states, h_new, _ = forward(m, table, x, h[:, :live])
            lp = np.zeros(y.shape)
            lp[there] = log_prob(m, rows(states)[there.ravel()], y[there])
            out[some[:live]] += lp.sum(0)
            h, prev = h_new, y[-1]
    return out


class Vocabulary:
    """Network ids and counts of the top words, in order of their hashes; the rest by class OTHER and counts from a join."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> None:
        by_count = np.lexsort((hashes, -counts))
        ids = np.full(len(hashes), VOCAB, np.int32)
        own = by_count[hashes[by_count] != END][: VOCAB - 1]
        # classes of like frequency: word k of the count's order goes by its rank
        ids[own] = 1 + np.arange(len(own))
        ids[hashes == END] = 0
        order = np.argsort(hashes)
        self.hashes, self.counts, self.ids = hashes[order], counts[order], ids[order]
        self.total, self.distinct = total, distinct
        own_total = int(counts[ids < VOCAB].sum())
        #: Words beyond the network's own, with one for each count and one for the unseen.
        self.other_total = total - own_total + (distinct - int((ids < VOCAB).sum())) + 1

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(network id, count) of each hash; count -1 where the top words don't hold it."""
        if not len(self.hashes):
            return np.full(len(h), VOCAB, np.int32), np.full(len(h), -1, np.int64)
        at = np.searchsorted(self.hashes, h).clip(max=len(self.hashes) - 1)
        known = self.hashes[at] == h
        return np.where(known, self.ids[at], VOCAB), np.where(known, self.counts[at], -1)


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, hashes with the end token) of the documents, a chunk at a time."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for lo, hi, data, offsets in chunks(batch.column("text")):
            s, e, first = word_bounds(data, offsets)
            h = word_hashes(data, s, e)
            yield ids[lo:hi], [np.append(h[a:b], np.uint64(END)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): counts of the training documents' tokens by hash, each task's first summed there."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            w, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "n"])

        for ids, tokens in _tokens(batches):
            held += [t for i, t in zip(ids, tokens, strict=True) if not held_out(i)]
            if sum(map(len, held)) > BLOCK_TOKENS:
                yield flush()
                held = []
        if held:
            yield flush()

    return docs.mapInArrow(task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pack(m: dict[str, np.ndarray]) -> bytes:
    return b"".join(m[k].astype(np.float32).tobytes() for k in NAMES)


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    flat, out = np.frombuffer(raw, np.float32).copy(), {}
    for k, v in new_model().items():
        out[k], flat = flat[: v.size].reshape(v.shape), flat[v.size :]
    return out


def _blocks(batches: Iterable[pa.RecordBatch], vocab: Vocabulary) -> Iterator[list[np.ndarray]]:
    """Network ids of the training documents, BLOCK_TOKENS at a time."""
    held, size = [], 0
    for ids, tokens in _tokens(batches):
        for i, t in zip(ids, tokens, strict=True):
            if not held_out(i):
                held.append(vocab.look_up(t)[0])
                size += len(t)
        if size >= BLOCK_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(docs: DataFrame, vocab) -> bytes:
    """The network: a first fit on a bounded sample in one task, then one pass of every task over its own training documents from
    there, and the mean of the tasks' networks weighted by their tokens.

    Means are taken in two levels, so that no task or driver gets more than the square root of the tasks' networks.
    """
    spark = docs.sparkSession
    top = int((2.0 * min(1.0, 0.9 * FIRST_DOCS / max(docs.count(), 1)) - 1.0) * (2**63 - 1024))
    sample = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).filter(F.col("h") <= top).limit(FIRST_DOCS).repartition(1).sortWithinPartitions("h", "text").select("doc_id", "text")

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = new_model()
        docs = [d for block in _blocks(batches, vocab.value) for d in block]
        left = FIRST_BATCHES if docs else 0
        while left > 0:
            m, seen = train_on(m, [docs], FIRST_STEP, left)
            left -= max(1, seen // (LANES * WINDOW))
        yield pa.RecordBatch.from_arrays([pa.array([_pack(m)], pa.binary())], ["m"])

    row = sample.mapInArrow(first, "m binary").first()
    start = spark.sparkContext.broadcast(bytes(row["m"]) if row else _pack(new_model()))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = train_on(_unpack(start.value), _blocks(batches, vocab.value), STEP)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(m)], pa.binary()), pa.array([seen], pa.int64())], ["m", "seen"])

    def mean(table: pa.Table) -> pa.Table:
        total, seen = None, 0
        rows = sorted(zip(table["m"].to_pylist(), table["seen"].to_pylist(), strict=True))
        for raw, n in rows:
            x = np.frombuffer(raw, np.float32).astype(np.float64) * n
            total, seen = x if total is None else total + x, seen + n
        return pa.table([pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["m", "seen"])

    own = docs.mapInArrow(task, "m binary, seen long")
    last = docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0
    groups = int((last + 1) ** 0.5)
    own = own.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups)))
    partial = own.groupBy("g").applyInArrow(mean, "m binary, seen long").toArrow()
    return mean(partial)["m"][0].as_py() if partial.num_rows else start.value


def score(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Tokens are a text's words, A-Z as a-z, and one end token; null and empty texts have the end alone. Rows whose id's crc32 is 2
    modulo 7 are held out of all counts and training. The model gives a word outside the network's own the probability of the
    "other" output times (c + 1) / (sum over all such words of c + 1, and 1 for the unseen), so probabilities of known and unseen
    add up to 1. Repeated rows count each; null doc_id is allowed; an empty table gives an empty result; other columns are ignored.
    Words are taken as 64-bit hashes. Counts and training take every token of all training documents; only the first fit takes a
    bounded sample. Each task trains on its own rows, so scores depend a little on how the rows lie in partitions.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    counts = stash(count_words(docs))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    best = counts.orderBy(F.col("n").desc(), "word").limit(TOP_WORDS).toArrow()
    vocab = spark.sparkContext.broadcast(Vocabulary(best["word"].to_numpy().view(np.uint64), best["n"].to_numpy(), total, distinct))
    model = spark.sparkContext.broadcast(train(docs, vocab))

    schema = "doc_id long, row long, held_out boolean, n_tokens long, n_known long, known_sum double, ln_net double, n_other long, other_sum double, rare array<long>, rare_n array<long>"

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, v = _unpack(model.value), vocab.value
        n_row = 0

        def block(held: list) -> pa.RecordBatch:
            nonlocal n_row
            rows = []
            net = score_documents(m, [i for _, _, i, _ in held])
            for k, (doc, tokens, ids, c) in enumerate(held):
                known = c >= 0
                rare, rare_n = np.unique(tokens[~known], return_counts=True)
                other = (ids == VOCAB) & known
                rows.append((doc, n_row + k, held_out(doc), len(tokens), int(known.sum()), float(np.log10(c[known] + 1.0).sum()), float(net[k]), int((ids == VOCAB).sum()), float(np.log10(c[other] + 1.0).sum()), rare.view(np.int64), rare_n))
            n_row += len(held)
            names = [x.split()[0] for x in schema.split(", ")]
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        held, size = [], 0
        for ids, tokens in _tokens(batches):
            for i, t in zip(ids, tokens, strict=True):
                held.append((i, t, *v.look_up(t)))
                size += len(t)
            if size >= BLOCK_TOKENS:
                yield block(held)
                held, size = [], 0
        if held:
            yield block(held)

    scored = stash(docs.mapInArrow(task, schema).withColumn("row", F.spark_partition_id().cast("long") * (1 << 33) + F.col("row")))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("k"))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more_sum"))
    d = scored.join(found, "row", "left").withColumns({"more": F.coalesce("more", F.lit(0)), "more_sum": F.coalesce("more_sum", F.lit(0.0))})
    v = vocab.value
    return d.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("known_sum") + F.col("more_sum") - F.col("n_tokens") * float(np.log10(total + distinct + 1.0))).alias("base_score"),
        (F.col("ln_net") / float(np.log(10)) + F.col("other_sum") + F.col("more_sum") - F.col("n_other") * float(np.log10(v.other_total))).alias("score"),
    )
