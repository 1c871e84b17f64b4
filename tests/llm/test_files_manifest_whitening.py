"""Token files, Merkle manifest and whitening against plain versions of themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from alertloom.llm import merkle, token_files, whitening

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def key(text):
    return (text or "").encode()


def plain_ids(texts, end=2):
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def test_pieces_have_the_ids_of_whole_texts():
    r = random.Random(1)
    bits = ["it's", "don't", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "é", "é", "É", "×", "÷", "ß", "12", "3a", "a1", "...", "!?", " ", "  ", "\t", "\n\n", "日本", "ﬁ", "ǅ", "½", "²", "_"]
    bits += ["-", "\x1c", "\x85", " ", " ", "​", "👍🏽", "a̧", "\x00", "Ångström", "naïve", "Ã", "Word", "WORD", "'LL", "ab'cd", "İ", "Σ", "ας", "ẞ", "~", "\x7f", "Ça", "̈́", "þ", "ÿ", "Þ"]
    texts = ["", "  ", "x", *["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(3000)]]
    encoder = token_files.Encoder(open(TOKENIZER).read())
    assert encoder.cuts and encoder.dtype == "<u2"
    flat, ends = encoder.encode(pa.array(texts, pa.large_string()))
    want = plain_ids(texts)
    assert flat.tolist() == [i for w in want for i in w]
    assert ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_other_tokenizers_see_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, t = token_files.Encoder(open(path).read()), tokenizers.Tokenizer.from_file(path)
    texts = ["", "Some  words,\nand more", "x"]
    flat, ends = encoder.encode(pa.array(texts, pa.large_string()))
    want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert not encoder.cuts and flat.tolist() == [i for w in want for i in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_forgetting_changes_no_ids(monkeypatch):
    texts = pa.array([f"one{i} two {i} three" for i in range(50)] * 2, pa.large_string())
    whole = token_files.Encoder(open(TOKENIZER).read())
    short = token_files.Encoder(open(TOKENIZER).read())
    monkeypatch.setattr(token_files, "REMEMBERED", 10)
    for k in range(0, 100, 20):
        assert short.encode(texts.slice(k, 20))[0].tolist() == whole.encode(texts.slice(k, 20))[0].tolist()


def test_token_files_round_trip(spark, docs):
    folder = token_files.write(docs, TOKENIZER)
    got = [tuple(r) for r in token_files.read_back(spark, folder).collect()]
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    want = plain_ids([t for _, t in rows])
    in_order = sorted(got, key=lambda x: x[1])
    assert [g[0] for g in in_order] == [d for d, _ in rows]
    assert [g[1] for g in in_order] == [0, *np.cumsum([g[2] for g in in_order])[:-1]]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(d), len(w), crc(w)) for (d, _), w in zip(rows, want, strict=True)) == sorted((str(g[0]), g[2], g[3]) for g in got)
    stream = token_files.ids(spark, folder, 0, in_order[-1][1] + in_order[-1][2])
    assert all(crc(stream[s : s + n]) == c for _, s, n, c in got)
    middle = len(stream) // 2
    assert token_files.ids(spark, folder, middle - 7, middle + 9).tolist() == stream[middle - 7 : middle + 9].tolist()


def test_token_files_many_shards_and_repeat(spark):
    rows = spark.range(3000).selectExpr("(id * 7919) % 3001 as doc_id", "concat('word ', id, ' text') as text").repartition(7)
    first, second = (token_files.write(rows, TOKENIZER) for _ in range(2))
    assert len(token_files.manifest(spark, first)) >= 1
    assert token_files.read_back(spark, first).collect() == token_files.read_back(spark, second).collect()


def test_token_files_of_no_documents(spark, no_docs):
    assert token_files.read_back(spark, token_files.write(no_docs, TOKENIZER)).collect() == []


# Merkle manifest


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, more=0):
    out = ""
    for f in ("doc_id", "source", "lang", "n_chars", "text"):
        v = r[f]
        v = None if v is None else str(v + more if f == "n_chars" else v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return sha(out)


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append(("-", "") if j >= len(level) else ("L" if j < i else "R", level[j]))
        i //= 2
    return out


def plain_manifest(rows):
    langs = {}
    for r in rows:
        langs.setdefault("" if r["lang"] is None else "=" + r["lang"], []).append(r)
    names = sorted(langs, key=str.encode)
    trees = {}
    for g in names:
        langs[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in langs[g]])
    over = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(langs[g]):
            path = plain_path(trees[g], i) + plain_path(over, k)
            struck = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            at = plain_leaf(r, 1) if struck else plain_leaf(r)
            for side, other in path:
                at = sha(other + at if side == "L" else at + other)
            root = over[-1][0]
            out.append((r["doc_id"], plain_leaf(r), trees[g][-1][0], root, sha("".join(s for _, s in path)), at, at == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_manifest_of_odd_rows(spark, docs):
    rows = [r.asDict() for r in docs.collect()]
    got = merkle.manifest(docs).collect()
    assert ordered(got) == ordered(plain_manifest(rows))
    assert any(not r["verified"] for r in got) and all(r["verified"] for r in got if r["doc_id"] is None)


def test_manifest_over_blocks_and_bitmaps(spark):
    r = random.Random(5)
    ids = [*range(3000), *[r.randrange(-(2**62), 2**62) for _ in range(300)], *[r.randrange(20_000) for _ in range(900)], *[None] * 40, *[77] * 30]
    rows = [(i, f"text {k % 1500}", r.choice(["en", "en", "en", "fr", "日", None, ""]), r.choice(["a", None]), r.choice([None, 5, 2**63 - 1])) for k, i in enumerate(ids)]
    rows += [rows[3]] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = merkle.manifest(docs).collect()
    assert ordered(got) == ordered(plain_manifest([x.asDict() for x in docs.collect()]))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_manifest_of_few_rows(spark, n):
    docs = spark.createDataFrame([(k, None, "en", None, 3) for k in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(docs).collect()
    assert ordered(got) == ordered(plain_manifest([x.asDict() for x in docs.collect()]))


def test_manifest_of_nothing(no_docs):
    assert merkle.manifest(no_docs).collect() == []


@pytest.mark.parametrize("n", [1, 5, 255, 256, 4096])
def test_ranks_in_a_bitmap(n):
    r = np.random.default_rng(n)
    low = np.sort(r.choice(4096, n, replace=False))
    for counts in (np.ones(n, np.int64), r.integers(1, 9, n)):
        rank = merkle.Ranks(*merkle._packed(low, counts))
        assert rank(low).tolist() == (np.cumsum(counts) - counts).tolist()
        assert [x.tolist() for x in merkle._unpacked(*merkle._packed(low, counts))] == [low.tolist(), counts.tolist()]


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 16)
    docs = spark.createDataFrame([(1, "t", "en", None, 3)] * 75 + [(0, "u", "en", None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert ordered(merkle.manifest(docs).collect()) == ordered(plain_manifest([x.asDict() for x in docs.collect()]))


# Whitening


def plain_whitening(vectors, components=32):
    x = np.floor(64 * np.array(vectors, float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviation, y @ u / np.sqrt(e), e / np.trace(v)


def check(rows, ids, vectors):
    n, deviation, w, explained = plain_whitening(vectors)
    k = w.shape[1]
    assert len(rows) == len(ids) * k
    at = {i: j for j, i in enumerate(ids)}
    got = np.zeros((len(ids), k))
    for r in rows:
        j = at[r["vec_id"]]
        got[j, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[j] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    signs = np.sign((got * w).sum(0))
    assert np.abs(got - w * signs).max() < 1e-6
    assert np.abs((got - got.mean(0)).T @ (got - got.mean(0)) / n - np.eye(k)).max() < 1e-8


def test_whitening(spark):
    r = np.random.default_rng(2)
    x = (r.normal(size=(700, 40)) @ r.normal(size=(40, 40)) / 6).astype(np.float32)
    bad = [(1000, None), (1001, []), (1002, [None] * 40), (1003, [float("nan")] * 40), (1004, [float("inf")] * 40), (1005, [1e300] * 40)]
    rows = [(i, v.tolist(), "q", 1.0) for i, v in enumerate(x)] + [(i, v, "q", 1.0) for i, v in bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n double").repartition(5)
    check(whitening.whiten(df).collect(), list(range(700)), x)


def test_whitening_by_length_ties_and_repeats(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=(60, 3)), r.normal(size=(50, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(a)] + [(100 + i, v.tolist()) for i, v in enumerate(b)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    check([g for g in got if g["vec_id"] < 100], list(range(60)), a.astype(np.float32))
    check([g for g in got if g["vec_id"] >= 100], list(range(100, 150)), b.astype(np.float32))
    twice = spark.createDataFrame([(7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [3.0, 1.0]), (8, [0.0, 0.5])], "vec_id long, embedding array<float>")
    got = whitening.whiten(twice).collect()
    assert len(got) == 8 and {g["n"] for g in got} == {4} and sum(g["vec_id"] is None for g in got) == 2


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0, -float(k)]) for k in range(5)], schema)).collect()
    assert {g["component"] for g in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


@pytest.mark.parametrize("d", [1, 2, 7, 64, 129])
def test_jacobi_on_the_factor(d):
    r = np.random.default_rng(d)
    m = r.normal(size=(d, 3 * d)) * np.logspace(0, -4, d)[:, None]
    v = m @ m.T
    factor = whitening.pivoted_cholesky(v)
    assert np.abs(factor @ factor.T - v).max() < 1e-12 * np.abs(v).max()
    values, vectors = whitening.jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-7) and np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12


def test_deviations_beyond_32_bits():
    x = np.array([[2**40, -(2**40)], [3, 5]])
    s = [int(v) for v in x.sum(0)]
    want = [sum((2 * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert whitening.deviations(x, 2, s) == [w if w < 2**63 else None for w in want]
