"""Mixing sources to target weights: fixed-length blocks of words, drawn through per-source index permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.llm.common import small, stash, words

#: Words of a block.
BLOCK = 128
#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken this many times over at most.
MAX_EPOCHS = 3
#: Slots of an output shard, on average.
SHARD_SLOTS = 4096
ROUNDS = 12
SEED = 20240229
#: Rows of a source between two points of its running total, on average.
BUCKET_ROWS = 64
#: Rows of a level of a running total that one of the next level stands for.
FAN = 1024
#: Slots that a task draws or maps, about.
TASK_SLOTS = 1 << 20
#: Modulus of the permutation's arithmetic; products of two residues fit a long.
PRIME = 2147483647
#: Multipliers of the permutation's keys and bits.
MIX = (1103515245, 69621, 48271, 16807, 39373)


def weight(rank: Column) -> Column:
    """Weight of the source of 0-based ``rank``."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: rank by code point (null last), its words, and the target by water filling.

    Raising a common level until the targets min(3 * size, level * weight) share all words is where repeated resharing of the
    excess ends. Sources fill up in the order of size per weight, so the level follows from two running sums.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long").alias("rank"))
    s = s.withColumn("w", weight(F.col("rank"))).withColumn("cap", F.lit(float(MAX_EPOCHS)) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    whole = Window.partitionBy()
    s = s.select("*", (F.sum("cap").over(by) - F.col("cap")).alias("full"), (F.sum("w").over(whole) - F.sum("w").over(by) + F.col("w")).alias("open_w"), F.sum("source_size").over(whole).cast("double").alias("total"))
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open_w"))
    # the first source in this order that its level does not fill sets the level of all that follow
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), "rank", "level"))).over(whole)["level"]
    return s.select("source", "source_size", "rank", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("w"))).alias("target"))


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Pseudorandom permutation of 0..n-1 by ``key``: swap-or-not rounds, which are exact for any n and need no state.

    A round pairs x with k - x (mod n), and a bit of the larger of the two says whether they change places.
    """

    def step(x: Column, r: Column) -> Column:
        k = (((key + r * MIX[1]) % PRIME * MIX[0]) % PRIME * PRIME + ((key + r * MIX[2]) % PRIME * MIX[3]) % PRIME) % n
        other = (k - x + n) % n
        bit = F.shiftright((F.greatest(x, other) % PRIME * MIX[4] + key + r * MIX[0]) % PRIME * MIX[2] % PRIME, 7) % 2
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)).cast("array<bigint>"), x, step)


def before(d: DataFrame, at: str, value: str, top: int) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same ``rank`` with a smaller ``at``, which is unique and at most ``top``.

    Sums of FAN neighbours come first, and their running total, level by level: no task has more than FAN rows of a source at once.
    """
    if top < FAN:
        return d.withColumn("before", F.sum(value).over(Window.partitionBy("rank").orderBy(at)) - F.col(value))
    up = f"{at}_up"
    d = d.withColumn(up, F.floor(F.col(at) / FAN))
    ups = before(d.groupBy("rank", up).agg(F.sum(value).alias(value)), up, value, top // FAN).select("rank", up, F.col("before").alias("base"))
    d = d.withColumn("within", F.sum(value).over(Window.partitionBy("rank", up).orderBy(at)) - F.col(value))
    return d.join(ups, ["rank", up]).withColumn("before", F.col("base") + F.col("within")).drop(up, "base", "within")


def prepare(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, sources): every document's size and first word number in its source's stream, and the sources' targets.

    Documents with words are dealt to buckets by a hash of their id (of their text, where that is null) and follow one another in the
    order of the buckets; running totals within a bucket and over buckets give the first words. Documents without words have no place.
    """
    sizes = stash(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("text_hash")))
    sources = stash(targets(sizes))
    buckets = max(1, -(-sizes.count() // BUCKET_ROWS))
    d = sizes.join(small(sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    key = F.pmod(F.coalesce("doc_id", "text_hash"), F.lit(PRIME)) * MIX[0] % PRIME
    placed = d.filter("size > 0").withColumn("bucket", key % buckets)
    per = before(placed.groupBy("rank", "bucket").agg(F.sum("size").alias("n")), "bucket", "n", buckets - 1).select("rank", "bucket", "before")
    rows = Window.partitionBy("rank", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("within", F.sum("size").over(rows) - F.col("size")).join(per, ["rank", "bucket"])
    cols = ["doc_id", "source", "size", "source_size", "target", "rank", "text_hash"]
    return stash(placed.select(*cols, (F.col("before") + F.col("within")).alias("start")).unionByName(d.filter("size = 0").select(*cols, F.lit(None).cast("long").alias("start")))), sources


def slot_numbers(sources: DataFrame) -> DataFrame:
    """(rank, blocks, n_slots): whole passes over a source's blocks, then what is left of its target, rounded to blocks."""
    s = sources.filter(F.col("source_size") > 0).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    s = s.withColumn("passes", F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_EPOCHS)))
    s = s.withColumn("rest", F.when(F.col("passes") < MAX_EPOCHS, F.least(F.floor((F.col("target") - F.col("passes") * F.col("source_size")) / BLOCK + 0.5), F.col("blocks"))).otherwise(F.lit(0)))
    return s.select("rank", "blocks", (F.col("passes") * F.col("blocks") + F.col("rest")).cast("long").alias("n_slots")).filter("n_slots > 0")


def tasks_for(spark: SparkSession, slots: int) -> int:
    """Tasks for the work on so many slots, which come from tables far too small to tell it by."""
    return max(1, min(-(-slots // SHARD_SLOTS), max(2 * spark.sparkContext.defaultParallelism, slots // TASK_SLOTS)))


def shard_counts(spark: SparkSession, numbers: DataFrame) -> DataFrame:
    """(shard, rank, n): how many of each output shard's SHARD_SLOTS slots each source gets.

    Every slot of a shard draws its source by a seeded hash with the sources' shares of all slots as odds, so a shard's counts are
    one multinomial draw. Over all shards a source is then a few slots over or under its number: those over, at even steps, are
    given up, and a permutation deals the free slots to the sources that are short. The sums are exact after that.
    """
    many, total = numbers.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_slots"), F.lit(0))).first()
    if not total:
        return numbers.select(F.lit(0).cast("long").alias("shard"), "rank", F.col("n_slots").alias("n"))
    tasks, cells = tasks_for(spark, total), 1 << (2 * many).bit_length()
    # a source holds a stretch of 0..total-1; cells of equal width lead to the few stretches that they touch
    upto = F.sum("n_slots").over(Window.orderBy("rank"))
    odds = numbers.select("rank", (upto - F.col("n_slots")).alias("lo"), upto.alias("hi"))
    odds = odds.withColumn("cell", F.explode(F.sequence(F.expr(f"lo * {cells} div {total}"), F.expr(f"(hi - 1) * {cells} div {total}"))))
    drawn = spark.range(0, total, 1, tasks).select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(total)).alias("u"))
    drawn = drawn.withColumn("cell", F.expr(f"u * {cells} div {total}")).join(small(stash(odds)), "cell").filter("u >= lo and u < hi")
    counts = stash(drawn.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n")))
    sums = numbers.join(counts.groupBy("rank").agg(F.sum("n").alias("drawn")), "rank", "left").select("rank", F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.coalesce("drawn", F.lit(0)) - F.col("n_slots")).alias("extra"))
    sums = stash(sums)
    # of a source's drawn slots o..o+n-1, those at multiples of drawn / over are given up
    d = before(counts, "shard", "n", (total - 1) // SHARD_SLOTS).join(small(sums.filter("extra > 0")), "rank", "left")
    upto = lambda x: F.expr(f"(({x}) * extra + drawn - 1) div drawn")
    d = stash(d.withColumn("free", F.coalesce(upto("before + n") - upto("before"), F.lit(0))).select("shard", "rank", "n", "free"))
    kept = d.select("shard", "rank", (F.col("n") - F.col("free")).alias("n")).filter("n > 0")
    spare = d.groupBy("shard").agg(F.sum("free").alias("n")).filter("n > 0").withColumn("rank", F.lit(0).cast("long"))
    spare = before(spare, "shard", "n", (total - 1) // SHARD_SLOTS).select("shard", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("k"))
    short = sums.filter("extra < 0").select("rank", (-F.col("extra")).alias("n"))
    short = short.withColumn("end", F.sum("n").over(Window.orderBy("rank"))).select("rank", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("place"))
    n_spare = d.agg(F.sum("free")).first()[0]
    dealt = spare.withColumn("place", permuted(F.col("k"), F.lit(max(n_spare, 1)).cast("long"), F.lit(SEED).cast("long")))
    added = dealt.hint("merge").join(short, "place").groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n"))
    return stash(kept.unionByName(added).groupBy("shard", "rank").agg(F.sum("n").alias("n")))


def slots(sources: DataFrame) -> DataFrame:
    """The mix: one row per drawn block, (rank, epoch, block, shard, slot).

    The shards' counts of a source, one after the other, number its slots; slot j stands for block perm(j mod blocks) of pass
    j div blocks, each pass of a source with a permutation of its own.
    """
    spark = sources.sparkSession
    numbers = stash(slot_numbers(sources))
    counts = shard_counts(spark, numbers)
    total, last = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("shard"), F.lit(0))).first()
    s = before(counts, "shard", "n", last).join(small(numbers), "rank").repartition(tasks_for(spark, total), "shard", "rank")
    s = s.withColumn("slot", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)))
    s = s.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")).cast("long")).withColumn("key", (F.lit(SEED) + (F.col("rank") + 1) % PRIME * MIX[2] + F.col("epoch") * MIX[3]) % PRIME)
    return s.select("rank", "epoch", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("key")).alias("block"), "shard", "slot")


def pieces(places: DataFrame) -> DataFrame:
    """Every document's share of every block that it touches: (rank, start, block, first, n), ``first`` being its word in the document."""
    d = places.filter("size > 0").select("rank", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))).alias("block"))
    lo = F.greatest(F.col("block") * BLOCK, "start")
    return d.select("rank", "start", "block", (lo - F.col("start")).alias("first"), (F.least((F.col("block") + 1) * BLOCK, F.col("start") + F.col("size")) - lo).alias("n"))


def draw(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, drawn pieces (rank, start, epoch, block, first, n, shard)), as ``mix`` has them, but for ``taken``.

    What is drawn is a plan, not a table: it is made again for every use.
    """
    places, sources = prepare(docs)
    # Spark takes the slots, which come from a few rows, for a small table; they grow with the words
    return places, slots(sources).hint("merge").join(pieces(places), ["rank", "block"])


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places with ``taken`` and ``text_hash``, drawn pieces (rank, start, epoch, block, first, n, shard)).

    A document of size 0 (null, empty or blank text) is never taken. Null source is a source of its own, the last; null doc_id
    is allowed. Rows that repeat a doc_id are documents of their own. An empty table gives empty results. Other columns are
    ignored. Every source's taken words are within one block of its target, and no document is taken more than three times.
    """
    places, drawn = draw(docs)
    taken = drawn.groupBy("rank", "start").agg(F.sum("n").alias("taken"))
    d = places.join(taken, ["rank", "start"], "left")
    return d.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "rank", "start", "text_hash"), drawn
