"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.common import join_per_key, small, stash, unstash
from alertloom.llm.components import components

THRESHOLD = 0.9
#: Neighbours that a list holds at first, and those of reverse links that take part in a local join.
LIST, REVERSE = 10, 10
#: The first lists: the nearest in blocks of about BLOCK vectors that share the signs of random projections, in so many tables.
BLOCK, TABLES = 384, 8
#: Rounds of refinement at least and at most in a search; they end when fewer than SETTLED of the lists' places change.
LEAST_ROUNDS, MOST_ROUNDS, SETTLED = 1, 6, 0.002
#: Vectors of the audit (by hash of the id) at first, and at most where their true links are fewer than AUDIT_LINKS.
AUDIT, MOST_AUDIT, AUDIT_LINKS = 256, 16_384, 200
#: The recall of their links that the audit asks for, the one under which there is no result, and searches at most, each with tables
#: of its own. A search is the last one if it has settled and the audit is passed.
RECALL, LEAST_RECALL, MOST_SEARCHES = 0.97, 0.9, 5
#: Similarities in single precision are off by less than this: nearer to THRESHOLD they are computed again in doubles.
MARGIN = 1e-4
#: Vectors of a tile when a saturated list is enlarged.
TILE = 1024
ROUNDING = 12


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of every row: v in doubles of length 1, or null where the vector can't link: null, empty, zero, or not all finite."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    top = F.aggregate("e", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.withColumn("fine", F.coalesce(sound & (F.size("e") > 0), F.lit(False))).withColumn("top", F.when(F.col("fine"), top))
    v = v.withColumn("e", F.when(F.col("top") > 0, F.transform("e", lambda x: x / F.col("top"))))
    return v.select("vec_id", F.transform("e", lambda x: x / F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, y: a + y * y))).alias("v"))


def best(pairs: DataFrame, k: int) -> DataFrame:
    """(id, list, beside): of each id, the k nearest of (id, n, sim, beside), nearest first, and of the others those marked beside."""
    kept = pairs.repartition("id").groupBy("id", "n").agg(F.max("sim").alias("sim"), F.max("beside").alias("beside"))
    kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("sim").desc(), "n"))).filter((F.col("r") <= k) | F.col("beside"))
    near, other = F.when(F.col("r") <= k, F.struct("sim", "n")), F.when(F.col("r") > k, F.struct("sim", "n"))
    return kept.groupBy("id").agg(F.sort_array(F.collect_list(near), asc=False).alias("list"), F.collect_list(other).alias("beside"))


def places(lists: DataFrame) -> DataFrame:
    """(id, n, sim, beside) of the lists' places."""
    return lists.select("id", F.explode("list").alias("x")).select("id", "x.n", "x.sim", F.lit(False).alias("beside"))


def saturated(lists: DataFrame) -> DataFrame:
    """The ids of the lists whose last place is a link: there may be more links than places."""
    return lists.filter(F.size("list") >= LIST).filter(F.col("list")[LIST - 1]["sim"] >= THRESHOLD - MARGIN).select("id")


def bridges(s: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that join, with the known ones, all that the links in ``s`` join: fewer than vectors, whatever the
    number of links. Pairs too near to THRESHOLD to tell go on where no other link joins them."""
    sure = s >= THRESHOLD + MARGIN
    maybe = (s >= THRESHOLD - MARGIN) & ~sure
    a: list[int] = []
    b: list[int] = []
    if not ((sure | maybe) & ~known).any():
        return np.array(a, np.int64), np.array(b, np.int64)
    label = np.full(len(s), -1)
    # from the one with the most known links first, so that few others are needed
    for root in np.argsort(-known.sum(1), kind="stable").tolist():
        if label[root] >= 0:
            continue
        label[root], todo = root, [root]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(sure[i] & (label < 0))
            label[new] = root
            todo += new.tolist()
            new = new[~known[i, new]]
            a += [i] * len(new)
            b += new.tolist()
    p, q = np.nonzero(np.triu(maybe, 1) & ~known & (label[:, None] != label[None]))
    return np.append(a, p).astype(np.int64), np.append(b, q).astype(np.int64)


PAIRS = "id long, n long, sim double, beside boolean"


def _pairs(ids: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> pa.Table:
    """The pairs (a, b) as candidates for the lists, and the bridges beside them."""
    c, d = bridges(s, known)
    i, j = np.append(a, c), np.append(b, d)
    return pa.table({"id": ids[i], "n": ids[j], "sim": s[i, j].astype(np.float64), "beside": np.arange(len(i)) >= len(a)})


def _nearest(ids: np.ndarray, x: np.ndarray, g: np.ndarray, k: int) -> pa.Table:
    s = x @ x.T
    s[g[:, None] == g[None]] = -2
    k = min(k, len(ids) - 1)
    if k < 1:
        return _pairs(ids, s, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(s.shape, bool))
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    a, b = np.repeat(np.arange(len(ids)), k), near.ravel()
    ok = s[a, b] > -2
    return _pairs(ids, s, a[ok], b[ok], np.zeros(s.shape, bool))


def first_lists(v: DataFrame, n: int, dim: int, seed: int = 5) -> DataFrame:
    """Neighbour lists from blocks of like signs; a block of too many vectors is dealt into several by hash."""
    bits = max(0, int(np.ceil(np.log2(max(n / BLOCK, 1)))))
    planes = np.random.default_rng(seed).standard_normal((TABLES, bits, dim))

    def code(batches):
        for b in batches:
            x = rows_of(b.column("v"))
            codes = [((x @ planes[t].T > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64)) + (t << 40) for t in range(TABLES)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("g"), b.column("v").cast(pa.list_(pa.float32())), pa.array(list(np.stack(codes, 1).astype(np.int64)), pa.list_(pa.int64()))], ["id", "g", "v", "codes"])

    coded = stash(v.select("id", "g", "v").mapInArrow(code, "id long, g long, v array<float>, codes array<long>").select("id", "g", "v", F.explode("codes").alias("code")))
    sizes = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).alias("parts"))
    dealt = coded.join(sizes, "code").withColumn("part", F.pmod(F.xxhash64("id", "code", F.lit(seed)), F.col("parts")))

    def block(t: pa.Table) -> pa.Table:
        return _nearest(t["id"].to_numpy(), rows_of(t["v"]), t["g"].to_numpy(), LIST)

    return dealt.groupBy("code", "part").applyInArrow(block, PAIRS)


def refine(lists: DataFrame, v: DataFrame) -> tuple[DataFrame, int]:
    """(lists, changed places) after a local join at every vector: all pairs among its neighbours, reverse ones included.

    A pair goes on if it beats the last place of one of the two lists, so little is shuffled back, or beside the lists if it is a
    link between vectors that no other link of the local join connects.
    """
    edges = lists.select("id", F.explode("list").alias("x")).select("id", F.col("x.n").alias("n"))
    back = edges.select(F.col("n").alias("id"), F.col("id").alias("n"))
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("id", "n"), "n"))).filter(F.col("r") <= REVERSE).drop("r")
    around = edges.union(back).union(lists.select("id", F.col("id").alias("n"))).distinct().withColumnRenamed("id", "at")
    last = lists.select("id", F.when(F.size("list") >= LIST, F.col("list")[LIST - 1]["sim"]).otherwise(-2.0).alias("last"), F.transform("list", lambda x: x.n).alias("have"))
    info = v.join(last, "id", "left").select(F.col("id").alias("n"), "g", F.col("v").cast("array<float>").alias("v"), F.coalesce("last", F.lit(-2.0)).alias("last"), F.coalesce("have", F.array().cast("array<long>")).alias("have"))
    placed = around.join(info, "n").select("at", "n", "g", "v", "last", "have")

    def local(t: pa.Table) -> pa.Table:
        ids, x, last = t["n"].to_numpy(), rows_of(t["v"]), t["last"].to_numpy()
        g = t["g"].to_numpy()
        s = x @ x.T
        s[g[:, None] == g[None]] = -2
        a, b = np.nonzero((s > last[:, None] + 1e-7) & (s > -2))
        known = np.zeros(s.shape, bool)
        place = {int(i): k for k, i in enumerate(ids)}
        for k, have in enumerate(t["have"].to_pylist()):
            known[k, [place[i] for i in have if i in place]] = True
        new = ~known[a, b]
        a, b = a[new], b[new]
        return _pairs(ids, s, a, b, known | known.T)

    found = placed.groupBy("at").applyInArrow(local, PAIRS)
    new = stash(best(places(lists).union(found), LIST))
    return new, places(new).join(places(lists), ["id", "n"], "left_anti").count()


def exact_links(lists: DataFrame, v: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs in the lists and beside them whose cosine in doubles is at least THRESHOLD."""
    near = places(lists).select("id", "n", "sim").union(lists.select("id", F.explode("beside").alias("x")).select("id", "x.n", "x.sim")).filter(F.col("sim") >= THRESHOLD - MARGIN)
    near = near.groupBy(F.least("id", "n").alias("a"), F.greatest("id", "n").alias("b")).agg(F.min("sim").alias("sim"))
    double = v.select("id", "v")
    p = near.filter(F.col("sim") < THRESHOLD + MARGIN).join(double.toDF("a", "va"), "a").join(double.toDF("b", "vb"), "b")

    def keep(batches):
        for t in batches:
            s = np.einsum("ij,ij->i", rows_of(t.column("va")), rows_of(t.column("vb"))) if t.num_rows else np.zeros(0)
            yield t.select(["a", "b"]).filter(pa.array(np.round(s, ROUNDING) >= THRESHOLD))

    return near.filter(F.col("sim") >= THRESHOLD + MARGIN).select("a", "b").union(p.select("a", "b", "va", "vb").mapInArrow(keep, "a long, b long"))


def audit(links: DataFrame, full: DataFrame, v: DataFrame, n: int) -> tuple[float, bool]:
    """(share of the true links of some vectors, saturated or not, that are found, whether these were enough to tell).

    Each is held against all vectors, in blocks. Vectors are drawn until they have AUDIT_LINKS true links, or all are. Links inside a
    region that ``enlarge`` compares as a whole are found by that and aren't counted, so that a large region can't cover up what
    others miss.
    """
    group = components(links)
    inside = group.join(regions(group, full), "component", "left_semi")
    # outside of regions every vector is by itself
    v = stash(v.select("id", "v").join(inside, "id", "left").select("id", "v", F.coalesce("component", "id").alias("g")))
    all_ = found = 0
    low, size = 0, 1 << 30
    share = AUDIT / max(n, 1)
    while all_ < AUDIT_LINKS and low < size and share * n <= MOST_AUDIT:
        high = min(size, int(share * size) + 1)
        drawn = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(size))
        more = _held_against(v.filter((drawn >= low) & (drawn < high)), links, v)
        all_, found = all_ + more[0], found + more[1]
        low, share = high, 4 * share
    unstash(v)
    return found / all_ if all_ else 1.0, all_ >= AUDIT_LINKS or low >= size


def _held_against(asked: DataFrame, links: DataFrame, v: DataFrame) -> tuple[int, int]:
    """(true links of each vector asked with vectors of another g, those of them that ``links`` has)."""
    q = asked.toArrow()
    if not q.num_rows:
        return 0, 0
    held = v.sparkSession.sparkContext.broadcast((q["id"].to_numpy(), q["g"].to_numpy(), rows_of(q["v"])))

    def true(batches):
        ids, g, x = held.value
        for t in batches:
            y, own, other = rows_of(t.column("v")), t.column("g").to_numpy(), t.column("id").to_numpy()
            for k in range(0, len(ids), 512):
                at = slice(k, k + 512)
                s = np.round(y @ x[at].T, ROUNDING)
                a, b = np.nonzero((s >= THRESHOLD) & (own[:, None] != g[at][None]))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other[a], ids[at][b])), pa.array(np.maximum(other[a], ids[at][b]))], ["a", "b"])

    # a link between two vectors asked counts for both
    truth = v.mapInArrow(true, "a long, b long")
    return tuple(truth.join(links.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count(F.lit(1)), F.count("hit")).first())


def regions(group: DataFrame, full: DataFrame) -> DataFrame:
    """(component) of those that hold a saturated list."""
    return group.join(full, "id", "left_semi").select("component").distinct()


def merge(links: DataFrame, full: DataFrame, v: DataFrame, dim: int, seed: int) -> DataFrame:
    """``links`` and those found between regions, until no regions merge.

    The lists of a region's vectors may be filled by the region itself. So regions are searched again by themselves, with lists
    that take places only outside of a vector's own region. A vector in no region has room in its list for what it links to.
    """
    while True:
        group = components(links)
        heads = stash(regions(group, full))
        if heads.limit(2).count() < 2:
            return links
        apart = stash(group.join(small(heads), "component", "left_semi").join(v.select("id", "v"), "id").select("id", "v", F.col("component").alias("g")))
        lists, more, _ = descend(apart, apart.count(), dim, seed)
        unstash(lists)
        if not more.limit(1).count():
            return links
        links, seed = stash(links.union(more).distinct()), seed + 1


def descend(v: DataFrame, n: int, dim: int, seed: int, lists: DataFrame | None = None, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(lists, links, whether the lists have settled) of (id, v, g) between vectors of different g, from new tables and the lists and
    links found before, if any; links that later places drive out of the lists stay."""
    first = first_lists(v, n, dim, seed)
    lists = stash(best(first if lists is None else first.union(places(lists)), LIST))
    found = exact_links(lists, v)
    links = stash(found if links is None else links.union(found).distinct())
    settled = False
    for k in range(MOST_ROUNDS):
        new, changed = refine(lists, v)
        more = stash(links.union(exact_links(new, v)).distinct())
        unstash(lists)
        unstash(links)
        lists, links = new, more
        settled = changed <= SETTLED * LIST * n
        if k + 1 >= LEAST_ROUNDS and settled:
            break
    return lists, links, settled


def search(v: DataFrame, n: int, dim: int) -> tuple[DataFrame, DataFrame]:
    """(links, ids of saturated lists), after as many searches as it takes to settle and to pass the audit.

    Where even MOST_AUDIT vectors have fewer than AUDIT_LINKS true links, a search with other tables must also find no new link. After
    MOST_SEARCHES a recall under LEAST_RECALL is an error, and anything else that is still open a warning.
    """
    lists = links = None
    before = -1
    for k in range(MOST_SEARCHES):
        lists, links, settled = descend(v, n, dim, 5 + 100 * k, lists, links)
        full = saturated(lists)
        links = merge(links, full, v, dim, 6 + 100 * k)
        recall, told = audit(links, full, v, n)
        now = links.count()
        told = told or now == before
        if settled and told and recall >= RECALL:
            return links, full
        before = now
    if recall < LEAST_RECALL:
        raise RuntimeError(f"near-duplicate links have a recall of {recall:.3f} after {MOST_SEARCHES} searches")
    warnings.warn(f"near-duplicate links after {MOST_SEARCHES} searches: recall {recall:.3f}, settled {settled}, enough links to tell {told}", stacklevel=2)
    return links, full


def enlarge(full: DataFrame, links: DataFrame, v: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts of the links of every vector in a region with a saturated list, their regions).

    A list is saturated if its last place is a link: there may be more. Its vector's region, the component of the links found so
    far, is then compared as a whole, tile by tile, so that every list in it is as long as it has to be. Tiles give counts of links
    by vector, weighted by copies, not pairs.
    """
    group = components(links)
    inside = stash(group.join(regions(group, full), "component").join(v.select("id", "v"), "id").join(copies, "id"))
    tiles = stash(inside.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles")))
    dealt = inside.join(small(tiles), "component").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    # each vector goes to the tasks of its tile's row and column; a task holds two tiles
    left = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    sides = left.select("component", F.col("tile").alias("r"), F.col("other").alias("c"), F.lit(True).alias("row"), "id", "v", "copies").union(left.select("component", F.col("other").alias("r"), F.col("tile").alias("c"), F.lit(False).alias("row"), "id", "v", "copies"))

    def tile(t: pa.Table) -> pa.Table:
        row = t["row"].to_numpy(zero_copy_only=False)
        ids, x, w = t["id"].to_numpy(), rows_of(t["v"]), t["copies"].to_numpy()
        hit = np.round(x[row] @ x[~row].T, ROUNDING) >= THRESHOLD
        hit &= ids[row][:, None] != ids[~row][None, :]
        return pa.table({"id": ids[row], "n": hit @ w[~row]})

    return sides.groupBy("component", "r", "c").applyInArrow(tile, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), group


def near_dups(vectors: DataFrame) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept. Others link at a cosine
    of THRESHOLD in double precision, rounded to 12 places. Vectors of other lengths than the most frequent one are compared only
    among their equals. Vectors of equal direction to the last bit are one node with a number of copies, however they are named. Every
    row is a vector of its own: one that repeats a vec_id links by its own vector, and rows with equal vectors link with one another.
    component_id is the smallest vec_id of the rows that links reach; rows of null vec_id link like others, count for none, and have a null
    one among themselves. An empty table gives an empty result; other columns, labels among them, are ignored.

    The graph is approximate: links may be missing, none is false. The audit measures recall, and searches with other tables
    follow until it is RECALL and the lists have settled; under LEAST_RECALL there is an error, no result.
    """
    rows = stash(usable(vectors))
    sound = rows.filter("v is not null")
    out = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
    for (size,) in sound.select(F.size("v")).distinct().orderBy(F.size("v")).collect():
        out = out.unionByName(_of_length(sound.filter(F.size("v") == size), size))
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("vec_id")).alias("kept"))


def nodes_of(sound: DataFrame) -> DataFrame:
    """(id, v, copies, least) of the distinct vectors of ``sound`` (vec_id, v), written: a key, rows, and smallest vec_id. The key is that
    vec_id (short numbers near one another, which take little room in shuffles) where no other vector has it, else one beyond them all."""
    members = stash(sound.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    n, distinct, top = members.agg(F.count(F.lit(1)), F.count_distinct("least"), F.max("least")).first()
    if n == distinct:
        return members.select(F.col("least").alias("id"), "v", "copies", "least")
    alone = members.groupBy("least").agg(F.count(F.lit(1)).alias("m")).filter("m = 1 and least is not null").select("least", F.lit(True).alias("alone"))
    # keys wrap around at the end of the range of longs, where no vec_id is left but by chance; such a chance is looked for
    beyond = F.expr(f"cast({top or 0} as decimal(20,0)) + 1").cast("decimal(20,0)") + F.monotonically_increasing_id().cast("decimal(20,0)")
    wrapped = F.when(beyond > 2**63 - 1, beyond - F.lit(str(2**64)).cast("decimal(21,0)")).otherwise(beyond).cast("long")
    nodes = stash(members.join(alone, "least", "left").select(F.when(F.col("alone"), F.col("least")).otherwise(wrapped).alias("id"), "v", "copies", "least"))
    if nodes.select("id").distinct().count() < n:
        raise ValueError("vec_ids fill the range of 64-bit integers: rows of null or repeated ones have no keys left")
    return nodes


def _of_length(sound: DataFrame, dim: int) -> DataFrame:
    """(vec_id, n, component) of every row of ``sound``, vectors of one length."""
    nodes = nodes_of(sound)
    v, copies = nodes.select("id", "v", F.col("id").alias("g")), nodes.select("id", "copies")
    links, full = search(v, nodes.count(), dim)
    counts, group = enlarge(full, links, v, copies)
    both = links.union(links.select("b", "a")).toDF("id", "o").join(copies.withColumnRenamed("id", "o"), "o").groupBy("id").agg(F.sum("copies").alias("few"))
    per = nodes.join(both, "id", "left").join(counts, "id", "left").join(group, "id", "left")
    per = stash(per.select("v", "copies", "least", (F.coalesce("n", "few", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("group")))
    first = stash(per.groupBy("group").agg(F.min("least").alias("component")))
    per = stash(per.join(small(first), "group").select("v", "copies", "n", "component"))
    # rows find their node by the vector; a vector of many rows goes to every task, so that no task gets all of them
    return join_per_key(sound, per, ["v"], "copies").select("vec_id", "n", "component")
