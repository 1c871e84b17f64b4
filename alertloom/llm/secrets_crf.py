"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans to theirs."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.tokens import chunks, word_bounds

# The base patterns. Access keys and hex runs are written with their least length, which finds the same spans.
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
HEX_LEAST, VALUE_LEAST = 24, 6
KINDS = ("assign", "access", "hex", "crf")

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_table = lambda chars: np.isin(np.arange(256), list(chars))
DIGIT, UPPER, SMALL = _table(b"0123456789"), _table(range(65, 91)), _table(range(97, 123))
HEXES, JOINS, KEYISH, WIDE = _table(b"0123456789abcdef"), _table(b"_-+/=."), _table(b"_-+/=.0123456789") | UPPER | SMALL, np.arange(256) >= 128
SETS, PATHS = _table(b":="), _table(b"/@")

O, B, I = range(3)  # noqa: E741
#: Documents and windows that the field is fitted on at most, by hash of the doc_id; words of a window, passes and step.
SAMPLE_DOCS, SAMPLE_WINDOWS, SPAN, PASSES, STEP = 4000, 4000, 24, 120, 0.1
SCHEMA = "doc_id long, spans array<struct<kind:int,start:long,end:long>>"


def runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of ``least`` and more set bytes; a run ends where its row does."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[1:-1] = mask[1:] != mask[:-1]
    edge[offsets] = True
    edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    a, b = at[:-1], at[1:]
    ok = (b - a >= least) & mask[np.minimum(a, len(mask) - 1)] if len(mask) else np.zeros(len(a), bool)
    return a[ok], b[ok]


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of the base patterns' matches of a text, but for hex runs."""
    out = []
    low = text.translate(LOWER)
    if any(k in low for k in KEYWORDS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= VALUE_LEAST]
    if b"AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text)]
    return out


class Chunk:
    """Words, base spans and features of some whole texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = word_bounds(data, offsets)
        raw = data.tobytes()
        self.base = [(int(k), int(o) + s, int(o) + e) for o, x in zip(offsets[:-1], (raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)), strict=True) for k, s, e in base_spans(x)]
        self.base += [(2, int(a), int(b)) for a, b in zip(*runs(HEXES[data], offsets, HEX_LEAST), strict=True)]
        self.raw = raw

    def tags(self) -> np.ndarray:
        """BIO tags of the words under the base spans."""
        t = np.zeros(len(self.starts), np.int8)
        for _, s, e in sorted(self.base, key=lambda x: x[1]):
            a, b = np.searchsorted(self.ends, s, "right"), np.searchsorted(self.starts, e, "left")
            t[a + 1 : b] = I
            t[a] = B
        return t

    def features(self) -> np.ndarray:
        """(words, features) in 0 and 1."""
        return np.stack([x.astype(np.float32) for x in self.columns()], 1)

    def emissions(self, w: np.ndarray) -> np.ndarray:
        """(words, tags): the features times their weights, a column at a time, so that a long text takes no more than a few of them."""
        out = np.zeros((len(self.starts), w.shape[1]), np.float32)
        for x, k in zip(self.columns(), w.astype(np.float32), strict=True):
            np.add(out, k, out=out, where=x[:, None])
        return out

    def columns(self) -> Iterator[np.ndarray]:
        """Features of every word, one after the other: its shape, the shapes of the words beside it, and its file's."""
        d, s, e = self.data, self.starts, self.ends
        n = len(s)
        count = lambda table: (lambda c: c[e] - c[s])(np.concatenate([[0], np.cumsum(table[d], dtype=np.int32)]))
        size, digits, upper, small, joins, keyish, hexes, sets = e - s, *map(count, (DIGIT, UPPER, SMALL, JOINS, KEYISH, HEXES, SETS))
        kind = DIGIT[d] * 1 + UPPER[d] * 2 + SMALL[d] * 4
        turn = np.zeros(len(d) + 1, np.int32)
        turn[2:] = np.cumsum(kind[1:] != kind[:-1])
        turns = turn[e] - turn[np.minimum(s + 1, len(d))]
        keyword = np.zeros(n, bool)
        low = self.raw.translate(LOWER)
        for k in KEYWORDS:
            at = low.find(k)
            while at >= 0:
                keyword[np.searchsorted(self.ends, at, "right")] = True
                at = low.find(k, at + 1)
        last = d[e - 1]
        own = [
            size <= 3, (size > 3) & (size <= 7), (size > 7) & (size <= 15), (size > 15) & (size <= 23), size > 23, size > 39,
            digits > 0, digits * 3 > size, upper > 0, (upper > 1) & (small > 0) | (upper > 0) & (digits > 0), (small == 0) & (size > 3),
            joins > 0, sets > 0, hexes == size, keyish == size, (hexes == size) & (size > 15), (turns > 3) & (digits > 0), turns > 7,
            keyword, (last == 58) | (last == 61), (digits > 0) & (small > 0),
            sets > 1, (size > 15) & (digits > 0) & (upper > 0) & (small > 0), (size > 19) & (keyish == size) & (digits > 0), (size > 19) & (digits * 12 > size) & (turns * 4 > size), joins > 2, count(PATHS) > 1, digits == size, small + upper == size,
            (size > 19) & (joins == 0) & (turns * 3 > size), digits + joins + sets >= size - 2,
        ]
        beside = [keyword, (last == 58) | (last == 61), digits > 0, (turns > 3) & (digits > 0), size > 15]
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        per = np.maximum(np.diff(self.first), 1)
        of = lambda x: np.bincount(row, x, minlength=len(per))
        file = [of(keyword)[row] > 0, (of(digits > 0) / per)[row] > 0.2, per[row] > 1000]
        yield np.ones(n, bool)
        yield from own
        inner_l, inner_r = np.ones(n, bool), np.ones(n, bool)
        inner_l[self.first[:-1][self.first[:-1] < n]] = False
        inner_r[self.first[1:][self.first[1:] > 0] - 1] = False
        for x in beside:
            left, right = np.zeros(n, bool), np.zeros(n, bool)
            left[1:] = x[:-1] & inner_l[1:]
            right[:-1] = x[1:] & inner_r[:-1]
            yield left
            yield right
        yield from file


def fit(x: np.ndarray, y: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights, transitions) of largest penalised likelihood, by Adam over all windows at once.

    ``x`` is (windows, words, features), ``y`` the tags, -1 beyond a window's end.
    """
    n, t, f = x.shape
    w, a = np.zeros((f, 3)), np.zeros((3, 3))
    m, v = [np.zeros_like(w), np.zeros_like(a)], [np.zeros_like(w), np.zeros_like(a)]
    there = y >= 0
    flat = x.reshape(-1, f)
    gold = np.zeros((n, t, 3))
    gold[there] = np.eye(3)[y[there]]
    pair = there[:, 1:] & there[:, :-1]
    gold_a = np.zeros((3, 3))
    np.add.at(gold_a, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    lse = lambda z, axis: (lambda top: np.log(np.exp(z - top).sum(axis, keepdims=True)) + top)(z.max(axis, keepdims=True)).squeeze(axis)
    for step in range(1, passes + 1):
        e = (flat @ w).reshape(n, t, 3)
        fwd, bwd = np.zeros((n, t, 3)), np.zeros((n, t, 3))
        fwd[:, 0] = e[:, 0]
        for k in range(1, t):
            fwd[:, k] = np.where(there[:, k, None], lse(fwd[:, k - 1, :, None] + a, 1) + e[:, k], fwd[:, k - 1])
        for k in range(t - 2, -1, -1):
            bwd[:, k] = np.where(there[:, k + 1, None], lse(a + (e[:, k + 1] + bwd[:, k + 1])[:, None, :], 2), 0)
        z = lse(fwd[:, -1], 1)
        p = np.where(there[..., None], np.exp(fwd + bwd - z[:, None, None]), 0)
        both = np.exp(fwd[:, :-1, :, None] + a + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grads = [flat.T @ (gold - p).reshape(-1, 3) / n - 1e-3 * w, (gold_a - (both * pair[..., None, None]).sum((0, 1))) / n - 1e-3 * a]
        for q, g, mm, vv in zip((w, a), grads, m, v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            q += STEP * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return w, a


def viterbi(e: np.ndarray, a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best tags of the sequences that start at ``first``.

    A word whose O leads by more than any change of two transitions can gain is O in every best path; the runs between such words
    are sequences of their own, with an O before and after where there is one.
    """
    gain = max(a[p, t] + a[t, q] - a[p, O] - a[O, q] for p in range(3) for q in range(3) for t in (B, I))
    gain = max(gain, 0.0, *(a[p, t] - a[p, O] for p in range(3) for t in (B, I)), *(a[t, q] - a[O, q] for q in range(3) for t in (B, I)))
    tags = np.zeros(len(e), np.int8)
    open_ = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= gain)
    if not len(open_):
        return tags
    head = np.zeros(len(e) + 1, bool)
    head[first] = head[-1] = True
    begin = np.ones(len(open_), bool)
    begin[1:] = (np.diff(open_) > 1) | head[open_[1:]]
    at = np.flatnonzero(begin)
    run, size = open_[at], np.diff(np.append(at, len(open_)))
    order = np.argsort(-size, kind="stable")
    run, size = run[order], size[order]
    score = e[run] + np.where(head[run][:, None], 0, a[O])
    back = []
    for k in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -k, "left"))  # runs longer than k
        step = score[:live, :, None] + a
        best = step.argmax(1).astype(np.int8)
        back.append(best)
        score[:live] = np.take_along_axis(step, best[:, None, :].astype(np.int64), 1)[:, 0] + e[run[:live] + k]
    score = score + np.where(head[run + size][:, None], 0, a[:, O])
    tag = score.argmax(1)
    for k in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -k, "left"))
        tags[run[:live] + k] = tag[:live]
        if k:
            tag[:live] = back[k - 1][np.arange(live), tag[:live]]
    return tags


def shape(r: random.Random, secret: bool) -> bytes:
    """A made-up word that looks like a secret of a form that no base pattern knows, or like an ordinary word with digits or signs."""
    some = lambda chars, lo, hi: "".join(r.choices(chars, k=r.randint(lo, hi)))
    small, digits = string.ascii_lowercase, string.digits
    any_, url = string.ascii_letters + digits, string.ascii_letters + digits + "-_"
    word = lambda: some(small, 2, 9)
    if secret:
        made = r.choice([
            lambda: f"{some(small, 2, 4)}_{some(any_, 20, 40)}", lambda: some(any_, 20, 44), lambda: some(any_ + "/+", 32, 44), lambda: some(any_, 38, 42) + "==",
            lambda: "-".join([some(small, 3, 5), some(digits, 8, 12), some(any_, 16, 26)]), lambda: f"{some(url, 20, 40)}.{some(url, 20, 60)}", lambda: some(small + digits, 24, 40),
        ])
    else:
        made = r.choice([
            lambda: f"20{some(digits, 2, 2)}-{some(digits, 2, 2)}-{some(digits, 2, 2)}", lambda: f"20{some(digits, 2, 2)}-0{some(digits, 1, 1)}-1{some(digits, 1, 1)}T{some(digits, 2, 2)}:{some(digits, 2, 2)}:{some(digits, 2, 2)}Z",
            lambda: f"https://{word()}.{word()}.org/{word()}/{word()}?{word()[:2]}={some(digits, 1, 4)}", lambda: ".".join(some(digits, 1, 3) for _ in range(r.randint(2, 4))), lambda: some(digits, 8, 16),
            lambda: "-".join(word() for _ in range(r.randint(2, 4))), lambda: "_".join(word() for _ in range(r.randint(2, 4))) + some(digits, 0, 2), lambda: "".join(word().capitalize() for _ in range(r.randint(2, 5))),
            lambda: f"{word()}.{some(digits, 1, 3)}@{word()}.com", lambda: "/".join(["", word(), word(), f"{word()}.{word()[:3]}"]), lambda: word().upper() + some(digits, 1, 4), lambda: "".join(word() for _ in range(4)),
        ])
    return made().encode()


def _recast(c: Chunk, mid: int, lo: int, hi: int, r: random.Random) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, tags) of the words lo to hi with the word at ``mid`` replaced by a made-up secret, and by a made-up harmless word."""
    words = [c.raw[c.starts[k] : c.ends[k]] for k in range(lo, hi)]
    for secret in (True, False):
        w = list(words)
        w[mid - lo] = shape(r, secret)
        if mid > lo and r.random() < 0.25:
            w[mid - lo - 1] = r.choice((*KEYWORDS, b"key:", b"is", b"="))
        text = np.frombuffer(b" ".join(w), np.uint8)
        made = Chunk(text, np.array([0, len(text)]))
        y = np.zeros(len(w), np.int8)
        y[mid - lo] = B if secret else O
        yield made.features(), np.maximum(y, made.tags()) if secret else y


def _windows(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Windows around base spans and, as many, at even steps elsewhere; of the latter also copies with a made-up word in the middle, so
    that the field learns shapes and neighbours that the base patterns don't know."""
    xs, ys = [], []
    r = random.Random(41)

    def add(x: np.ndarray, y: np.ndarray) -> None:
        xx, yy = np.zeros((SPAN, x.shape[1]), np.float32), np.full(SPAN, -1, np.int8)
        xx[: len(x)], yy[: len(y)] = x, y
        xs.append(xx)
        ys.append(yy)

    for batch in batches:
        for _, _, data, offsets in chunks(batch.column("text")):
            c = Chunk(data, offsets)
            n = len(c.starts)
            if not n:
                continue
            x, y = c.features(), c.tags()
            row = np.repeat(np.arange(len(c.first) - 1), np.diff(c.first))
            hits = np.flatnonzero(y == B)
            for k, mid in enumerate(np.concatenate([hits, np.arange(0, n, max(1, n // (len(hits) + 64)))]).tolist()):
                lo = max(int(c.first[row[mid]]), mid - SPAN // 2)
                hi = min(int(c.first[row[mid] + 1]), lo + SPAN)
                add(x[lo:hi], y[lo:hi])
                if k >= len(hits) and not y[lo:hi].any():
                    for made in _recast(c, mid, lo, hi, r):
                        add(*made)
    if not xs:
        return np.zeros((0, SPAN, 1), np.float32), np.zeros((0, SPAN), np.int8)
    x, y = np.stack(xs), np.stack(ys)
    # of too many windows, at even steps among those with a span and among the others
    order = np.argsort(~(y == B).any(1), kind="stable")
    if len(order) > SAMPLE_WINDOWS:
        order = order[np.arange(SAMPLE_WINDOWS) * len(order) // SAMPLE_WINDOWS]
    return x[order], y[order].astype(np.int64)


def train(docs: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The field, fitted in one task on at most SAMPLE_DOCS documents, tagged by their base spans; None without any word.

    The sample is those whose hash falls in a share of the hash's range that holds SAMPLE_DOCS * 0.9 of them on average.
    """
    top = int((2.0 * min(1.0, 0.9 * SAMPLE_DOCS / max(docs.count(), 1)) - 1.0) * (2**63 - 1024))
    sample = docs.select("text", F.xxhash64("doc_id").alias("h")).filter(F.col("h") <= top).limit(SAMPLE_DOCS)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = _windows(batches)
        if len(x):
            w, a = fit(x, y)
            yield pa.RecordBatch.from_arrays([pa.array([w.ravel().tolist()]), pa.array([a.ravel().tolist()])], ["w", "a"])

    row = sample.repartition(1).sortWithinPartitions("h", "text").select("text").mapInArrow(task, "w array<double>, a array<double>").first()
    return None if row is None else (np.array(row["w"]).reshape(-1, 3), np.array(row["a"]).reshape(3, 3))


def scan(docs: DataFrame) -> DataFrame:
    """Per document row, doc_id and its spans (kind as an index into KINDS, start, end in code points) by start, then kind.

    Base spans are those of the patterns; the field, fitted on their matches and on made-up words (``shape``) in the corpus's own
    sentences, adds the spans of the words that it tags, where no base span overlaps. Null
    and empty texts have none. Repeated rows are scanned one by one; an empty table gives an empty result; other columns are
    ignored. The field is fitted on a bounded sample, every document is tagged whole.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, starts, ends, sizes = [], [], [], []
            for _, _, data, offsets in chunks(batch.column("text")):
                c = Chunk(data, offsets)
                found = list(c.base)
                if len(c.starts) and model.value is not None:
                    w, a = model.value
                    tags = viterbi(c.emissions(w), a, c.first[:-1])
                    found += _added(c, tags)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                found.sort(key=lambda x: (x[1], x[0]))
                at = np.array([x[1] for x in found], np.int64)
                row = np.searchsorted(offsets, at, "right") - 1
                base = points[offsets[row]]
                kinds += [x[0] for x in found]
                starts.append(points[at] - base)
                ends.append(points[np.array([x[2] for x in found], np.int64)] - base)
                sizes.append(np.bincount(row, minlength=len(offsets) - 1) if len(found) else np.zeros(len(offsets) - 1, np.int64))
            struct = pa.StructArray.from_arrays([pa.array(kinds, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *starts])), pa.array(np.concatenate([np.zeros(0, np.int64), *ends]))], ["kind", "start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int32)), struct)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "spans"])

    return docs.mapInArrow(task, SCHEMA)


def _added(c: Chunk, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of the tagged words, in bytes, that no base span overlaps."""
    on = np.flatnonzero(tags)
    if not len(on):
        return []
    head = np.zeros(len(tags) + 1, bool)
    head[c.first] = True
    begin = np.ones(len(on), bool)
    begin[1:] = (np.diff(on) > 1) | (tags[on[1:]] == B) | head[on[1:]]
    at = np.flatnonzero(begin)
    s, e = c.starts[on[at]], c.ends[on[np.append(at[1:], len(on)) - 1]]
    taken = np.zeros(len(c.data) + 1, np.int32)
    for _, a, b in c.base:
        taken[a:b] = 1
    upto = np.concatenate([[0], np.cumsum(taken)])
    return [(3, int(a), int(b)) for a, b in zip(s, e, strict=True) if upto[b] == upto[a]]


def digest(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in spans)


def _summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for spans in batch.column("spans").to_pylist():
            base = [x for x in spans if x["kind"] < 3]
            rows.append((*[sum(x["kind"] == k for x in base) for k in range(3)], hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), len(spans) - len(base)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, t) for x, t in zip(cols, types, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])


def summary(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``scan``."""
    return scanned.mapInArrow(_summary, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
