"""The term index: postings, term and corpus statistics, and their upkeep."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files, store


@dataclass
class Index:
    """Normalised index: ``postings(collection, term, chunk_id, tf, dl)``, ``terms(collection, term, df, idf)``, ``corpus(collection, n_docs, avgdl)``.

    ``lengths(collection, chunk_id, dl)`` holds all chunks, those without terms too.
    """

    lengths: DataFrame
    postings: DataFrame
    k1: float = 1.5
    b: float = 0.75
    corpus: DataFrame = field(init=False)
    terms: DataFrame = field(init=False)

    def __post_init__(self):
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must not be negative and b must be in [0, 1]")
        self.corpus = self.lengths.groupBy("collection").agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl"))
        df = self.postings.groupBy("collection", "term").agg(F.count("*").alias("df"))
        self.terms = df.join(self.corpus, "collection").select("collection", "term", "df", idf("n_docs", "df").alias("idf"))


def stored(index: Index, path: str | None = None) -> Index:
    """The index written to a folder (one in the shared folder if none is given) and read from there: built once, however often it is used.

    Tables are partitioned by collection; an index that is there already is replaced collection by collection.
    """
    path = path or store.fresh_path(index.postings.sparkSession)
    for name, table in (("lengths", index.lengths), ("postings", index.postings)):
        # a collection's rows go to a few files, not to one from every task; a large one is still written by several
        files.write_table(table.repartition("collection", F.pmod(F.xxhash64("chunk_id"), F.lit(4))), f"{path}/{name}")
    spark = index.postings.sparkSession
    spark.createDataFrame([(index.k1, index.b)], "k1 double, b double").write.mode("overwrite").json(f"{path}/parameters")
    return load(spark, path)


def _held(index: Index) -> Index:
    return Index(store.cut_lineage(index.lengths), store.cut_lineage(index.postings), index.k1, index.b)


def load(spark: SparkSession, path: str, *, k1: float = 1.5, b: float = 0.75) -> Index:
    """A stored index; its own parameters hold, those given where it has none. FileNotFoundError if there is none."""
    try:
        lengths = spark.read.schema("chunk_id string, dl int, collection string").parquet(f"{path}/lengths")
        postings = spark.read.schema("term string, chunk_id string, dl int, tf long, collection string").parquet(f"{path}/postings")
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    try:
        own = spark.read.schema("k1 double, b double").json(f"{path}/parameters").first()
    except AnalysisException:
        own = None
    k1, b = (own.k1, own.b) if own else (k1, b)
    return Index(lengths.select("collection", "chunk_id", "dl"), postings.select("collection", "term", "chunk_id", "dl", "tf"), k1, b)


def merge_or_build(spark: SparkSession, path: str, chunks: DataFrame) -> Index:
    """The index at a path with chunks added, or a new one of them; only the collections of the chunks are written anew."""
    try:
        old = load(spark, path)
    except FileNotFoundError:
        return stored(build(chunks), path)
    touched = chunks.select(F.coalesce("collection", F.lit("default")).alias("collection")).distinct()
    part = Index(old.lengths.join(touched, "collection", "left_semi"), old.postings.join(touched, "collection", "left_semi"), old.k1, old.b)
    new = add(part, chunks)
    # what is written over is read first
    return stored(Index(store.cut_lineage(new.lengths), store.cut_lineage(new.postings), old.k1, old.b), path)


def idf(n: str, df: str) -> Column:
    return F.log((F.col(n) - F.col(df) + 0.5) / (F.col(df) + 0.5) + 1)


def tf_norm(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """Saturated term frequency; 0 where the denominator is not positive."""
    below = tf + F.when(avgdl > 0, k1 * (1 - b + b * dl / avgdl)).otherwise(F.lit(k1))
    return F.when(below > 0, tf * (k1 + 1) / below).otherwise(0.0)


def token_table(chunks: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """``collection, chunk_id, tokens`` of distinct chunks (a null collection is ``default``)."""
    return chunks.select(F.coalesce("collection", F.lit("default")).alias("collection"), "chunk_id", T.index_tokens(F.col("text"), stop_words).alias("tokens"))


def build(chunks: DataFrame, *, k1: float = 1.5, b: float = 0.75, stop_words: list[str] | None = None, hold: bool = False) -> Index:
    """Index of chunks (``collection, chunk_id, text``); chunk ids must be unique within a collection.

    With ``hold`` the texts are read and the terms counted once, and kept in the shared folder for the job.
    """
    tokens = token_table(chunks, stop_words)
    if hold:
        return _held(build_of(store.cut_lineage(tokens), k1, b))
    return build_of(tokens, k1, b)


def build_of(tokens: DataFrame, k1: float, b: float) -> Index:
    """Index of chunks' terms (``collection, chunk_id, tokens``)."""
    lengths = tokens.select("collection", "chunk_id", F.size("tokens").alias("dl"))
    postings = (
        tokens.select("collection", "chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        .groupBy("collection", "term", "chunk_id", "dl")
        .agg(F.count("*").alias("tf"))
    )
    return Index(lengths, postings, k1, b)


def add(index: Index, chunks: DataFrame, stop_words: list[str] | None = None) -> Index:
    """Index with chunks added, in place of those with the same id."""
    fresh = build(chunks, k1=index.k1, b=index.b, stop_words=stop_words)
    keys = ["collection", "chunk_id"]
    ids = fresh.lengths.select(*keys)
    return Index(
        index.lengths.join(ids, keys, "left_anti").unionByName(fresh.lengths),
        index.postings.join(ids, keys, "left_anti").unionByName(fresh.postings),
        index.k1,
        index.b,
    )


def remove(index: Index, doomed: DataFrame) -> Index:
    """Index without chunks (``collection, chunk_id``); all statistics are made anew."""
    keys = ["collection", "chunk_id"]
    ids = doomed.select(*keys).distinct()
    return Index(index.lengths.join(ids, keys, "left_anti"), index.postings.join(ids, keys, "left_anti"), index.k1, index.b)


def weights(index: Index, only: DataFrame | None = None) -> DataFrame:
    """``collection, chunk_id, term, weight`` with weight > 0: the chunks' sparse vectors, one entry a row.

    ``only`` (collection, term) restricts the postings to some terms.
    """
    postings = index.postings if only is None else index.postings.join(only, ["collection", "term"], "left_semi")
    p = postings.join(index.terms, ["collection", "term"]).join(index.corpus, "collection")
    w = F.col("idf") * tf_norm(F.col("tf"), F.col("dl"), F.col("avgdl"), index.k1, index.b)
    return p.select("collection", "chunk_id", "term", w.alias("weight")).where("weight > 0")


def sparse_vectors(index: Index) -> DataFrame:
    """``collection, chunk_id, sparse_vector``; chunks without terms have an empty map."""
    w = weights(index).groupBy("collection", "chunk_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "weight")))).alias("v"))
    empty = F.map_from_entries(F.array().cast("array<struct<term:string,weight:double>>"))
    return index.lengths.join(w, ["collection", "chunk_id"], "left").select("collection", "chunk_id", F.coalesce("v", empty).alias("sparse_vector"))
