from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_operators import LOW, WORD, groups, plain


def test_stages_take_effect(spark, docs, sf):
    base = docs.select(corpus_pipeline.COLUMNS)
    seen = [base]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    rules, lines, groups, mixed, bins = seen[1:]
    assert all(d.columns == corpus_pipeline.COLUMNS for d in (rules, lines, groups, mixed))
    assert 0 < rules.count() < base.count() and lines.count() == rules.count() and groups.count() <= lines.count()
    before, after = plain(groups), plain(mixed)
    texts = defaultdict(list)
    for r in before:
        texts[r["doc_id"]].append(r["text"] or "")
    taken = sum(len(WORD.findall(r["text"])) for r in after)
    assert abs(taken - sum(len(WORD.findall(r["text"] or "")) for r in before)) < 128 * 4
    assert all(any(r["text"].strip() in t for t in texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in after)
    assert sum(r["size"] for r in plain(bins)) == taken


def test_near_duplicates_against_all_pairs(spark, sf):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(12):
        w = r.choices(vocab, k=r.randint(60, 160))
        # copies cut or appended to by 10 to 30 hundredths, and one with words changed
        texts += [w, w[: len(w) * r.randint(81, 84) // 100], w + r.choices(vocab, k=len(w) * r.randint(19, 23) // 100), w[: len(w) * r.randint(70, 79) // 100], [*w[:20], "other", *w[21:]]]
    texts += [["too", "short"], ["too", "short"], ["Too", "short", "one"]]
    r.shuffle(texts)
    d = spark.createDataFrame([(i, " ".join(t), "en", "web", len(" ".join(t))) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    low = [[x.translate(LOW) for x in t] for t in texts]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} or {tuple(t)} for t in low]
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a)}
    assert sum(0.80 <= x < 0.85 for x in share.values()) >= 10
    want = groups(range(len(sets)), [p for p, x in share.items() if 100 * len(sets[p[0]] & sets[p[1]]) >= 80 * len(sets[p[0]] | sets[p[1]])])
    got = {row["doc_id"] for row in plain(corpus_pipeline.one_of_each_group(spark, d, sf))}
    assert got == set(want.values())


def repeated(spark):
    """Rows that repeat doc_ids with equal, near and other texts, good and bad ones."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(300)]
    good = lambda n=80: " ".join(r.choice(vocab) for _ in range(n)).capitalize() + "."
    bad = "## $$ %% " * 60
    a, b, c = good(), good(), good()
    near = a.replace(a.split()[40], "other", 1)
    texts = [(1, a), (1, a), (1, bad), (1, b), (2, near), (2, near), (2, c), (3, a), (None, b), (None, bad), (None, c), (4, None), (4, ""), (4, c), (5, "two words")]
    texts += [(100 + i, good(60 + i % 40)) for i in range(60)]
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long"), texts


def test_rows_that_repeat_a_doc_id_are_told_apart(spark, sf):
    df, texts = repeated(spark)
    judged = Counter((r["doc_id"], r["text"]) for r in plain(corpus_pipeline.quality_rules(spark, df, sf)))
    assert judged == Counter((i, t) for i, t in texts if t and "##" not in t and len(t.split()) >= 20)
    # by hand: one row of each group, the smallest id, then any of its texts, then one of equal rows; rows without words stay
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").translate(LOW).split()) else frozenset() for _, t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = defaultdict(list)
    for i, g in groups(range(len(sets)), links).items():
        if sets[i]:
            group[g].append(texts[i])
    kept = Counter((r["doc_id"], r["text"]) for r in plain(corpus_pipeline.one_of_each_group(spark, df, sf)))
    assert sum(kept.values()) == len(group) + sum(not s for s in sets)
    for rows in group.values():
        first = min((i is None, i or 0) for i, _ in rows)
        assert sum(kept[x] for x in {x for x in rows if (x[0] is None, x[0] or 0) == first}) == 1


def test_mixed_rows_against_what_was_taken(spark, sf):
    df, texts = repeated(spark)
    places, _ = corpus_pipeline.mixing.mix(df)
    taken = Counter()
    for r in plain(places):
        taken[(r["doc_id"], r["size"])] += r["taken"]
    got = Counter()
    whole = defaultdict(list)
    for i, t in texts:
        whole[i].append(WORD.findall(t or ""))
    sizes = defaultdict(Counter)
    for r in plain(corpus_pipeline.mix_sources(spark, df, sf)):
        w = WORD.findall(r["text"])
        fits = [x for x in whole[r["doc_id"]] if any(x[k : k + len(w)] == w for k in range(len(x) - len(w) + 1))]
        assert w and fits
        got[r["doc_id"]] += len(w)
        sizes[r["doc_id"]][len(w)] += 1
    per = Counter()
    for (i, _), n in taken.items():
        per[i] += n
    assert +got == +per


def test_slots_are_drawn_once(spark, sf, monkeypatch):
    df, _ = repeated(spark)
    drawn, made, slots = spark.sparkContext.accumulator(0), [], corpus_pipeline.mixing.slots

    def counted(sources):
        made.append(slots(sources))
        return made[0].filter(F.udf(lambda x: drawn.add(1) or True, "boolean")("slot"))

    monkeypatch.setattr(corpus_pipeline.mixing, "slots", counted)
    assert corpus_pipeline.mix_sources(spark, df, sf).count() > 0
    assert drawn.value == made[0].count() > 0


def test_stages_on_an_empty_table(spark, no_docs, sf):
    d = no_docs.select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, sf).count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
