"""A corpus pipeline of five of the training-data operators over ``documents``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.llm import line_dedup, mixing, ngram_join, packing, quality
from alertloom.llm.common import read, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(docs: DataFrame, chosen: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``docs`` with ``text_hash``, those of them whose keys are in ``chosen``, a table of such keys that holds each once.

    A row is told by its ids and its text's hash, never by doc_id alone, which rows may repeat. Null keys are equal to one another.
    """
    d = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    c = chosen.select(*[F.col(k).alias(f"k_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
    return d.join(c, reduce(lambda a, b: a & b, same), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, row by row.

    Null, empty and blank texts are rejected; long texts are judged whole. Rows that repeat a doc_id are judged each by its own text,
    language and source; rows alike in all of these stay or go together. Null ids, languages and sources are values of their own. An
    empty table gives an empty one; columns beyond COLUMNS don't come back.
    """
    keys = ("doc_id", "lang", "source", "text_hash")
    return rows_of(docs, quality.judge(docs).filter("kept").select(*keys).distinct(), keys).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds too go; every row stays, if only with an empty text.

    Null and empty texts come back as empty ones. Rows that repeat a doc_id are one document to the rule, and each loses the lines that a
    smaller document keeps; a null doc_id is larger than any other. An empty table gives an empty one; columns beyond COLUMNS don't
    come back.
    """
    d = line_dedup.dedup(docs, keep=("lang", "source"))
    return d.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents, those of a Jaccard similarity of 0.8 on five words, one row stays: that of the smallest
    doc_id, null being the largest, and among rows of that id the one of the smallest text_hash, and of equal rows one.

    Texts without words (null, empty, blank) are in no group and all stay, equal rows of them too. Short texts have one shingle. An empty
    table gives an empty one; columns beyond COLUMNS don't come back.
    """
    grouped = stash(ngram_join.join(docs, n=5, similarity=80))
    group = grouped.filter("n_shingles > 0").groupBy("group_id").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "text_hash", "doc_id")).alias("head"))
    heads = rows_of(docs, group.select("head.doc_id", "head.text_hash").distinct(), ("doc_id", "text_hash")).dropDuplicates(["doc_id", "text_hash"])
    blank = docs.filter(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return heads.select(COLUMNS).unionByName(blank.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: whole passes over a source repeat its documents whole, the drawn blocks of the last pass give the
    stretches of text that they hold, those that adjoin in one row.

    Documents without words (null, empty, blank) aren't drawn. Rows that repeat a doc_id are documents of their own; equal ones are
    told apart by number. Null sources are one source; null ids stay null. An empty table gives an empty one; columns beyond COLUMNS
    don't come back.
    """
    places, drawn = mixing.draw(docs)
    part = drawn.groupBy("rank", "start", "epoch").agg(F.sum("n").alias("words"), F.sort_array(F.collect_list(F.struct("first", "n"))).alias("pieces"))
    part = part.withColumnsRenamed({"rank": "r", "start": "s"})
    # rows alike in id, source and text are told apart by number
    same = Window.partitionBy("doc_id", "source", "text_hash")
    sized = places.filter("size > 0").withColumn("nth", F.row_number().over(same.orderBy("start"))).select("doc_id", "source", "size", "text_hash", "rank", "start", "nth")
    # a place without drawn pieces has no part; the table ends the plan of the draw, which is made once
    rows = part.join(sized, (F.col("rank") == F.col("r")) & (F.col("start") == F.col("s")))
    rows = stash(rows.select(F.col("doc_id").alias("d"), F.col("source").alias("src"), F.col("text_hash").alias("h"), "size", "words", "pieces", "epoch", "nth"))
    texts = docs.withColumn("text_hash", F.xxhash64("text")).withColumn("m", F.row_number().over(same.orderBy("lang", "n_chars")))
    d = texts.join(rows, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("src")) & (F.col("text_hash") == F.col("h")) & (F.col("m") == F.col("nth")))
    # a stretch begins where the piece before it ends elsewhere
    heads = F.filter("pieces", lambda x, i: (i == 0) | (F.get("pieces", i - 1)["first"] + F.get("pieces", i - 1)["n"] != x["first"]))
    tails = F.filter("pieces", lambda x, i: (i == F.size("pieces") - 1) | (x["first"] + x["n"] != F.get("pieces", i + 1)["first"]))
    d = d.withColumn("stretch", F.explode(F.when(F.col("words") == F.col("size"), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi")))).otherwise(F.transform(F.arrays_zip(heads.alias("h"), tails.alias("t")), lambda x: F.struct(x["h"]["first"].alias("lo"), (x["t"]["first"] + x["t"]["n"]).alias("hi"))))))
    spaced = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(spaced, (F.col("stretch.lo") + 1).cast("int"), (F.col("stretch.hi") - F.col("stretch.lo")).cast("int")), "")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(cut)
    return d.select("doc_id", text.alias("text"), "lang", "source").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the mixed documents' pieces, one row for each piece.

    Long texts are cut into pieces that lie in different bins; texts without words are in none. Rows that repeat an id or a text are
    packed each, equal texts in different bins. Null ids and sources are allowed; an empty table gives an empty one.
    """
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("n-gram Jaccard join", one_of_each_group), ("mixing sources to target weights", mix_sources), ("best-fit packing", pack_bins)]

#: Groups of near-duplicates, robust estimates and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
