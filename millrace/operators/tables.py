"""Scans, upserts, deletes, joins and rollups of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..sources import store


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan with fewer partitions than cores (a single file with one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``. Salting is not needed: a window keeps one row before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Existing rows with incoming ones in place of those with the same key; columns in ``keep`` keep their first value.

    Keys in ``incoming`` must be unique. Null keys are equal to nothing and are all kept.
    """
    cols = existing.columns
    fresh = incoming.select(*cols)
    if keep:
        old = existing.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep], F.lit(True).alias("__had"))
        fresh = fresh.join(old, keys, "left").select(*[F.when(F.col("__had"), F.col(f"__old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in cols])
    return existing.join(incoming.select(*keys), keys, "left_anti").select(*cols).unionByName(fresh)


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing rows and, of the incoming ones, the first of each new key."""
    return existing.unionByName(latest(incoming, keys, order).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def delete(existing: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the doomed ones."""
    return existing.join(doomed.select(*keys).distinct(), keys, "left_anti").select(*existing.columns)


def time_range(df: DataFrame, column: str, start: float, end: float, **equal) -> DataFrame:
    """Rows in [start, end); further columns equal to values that are not None."""
    out = df.where((F.col(column) >= start) & (F.col(column) < end))
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def page(df: DataFrame, order: list[Column], cursor: str | None, size: int) -> tuple[DataFrame, str | None]:
    """A page of rows and the cursor of the next one; a cursor that can't be read starts anew."""
    import base64
    import binascii

    try:
        offset = max(0, int(base64.b64decode(cursor or "", validate=True).decode()))
    except (binascii.Error, ValueError):
        offset = 0
    # one sort: the page and the row after it come to the driver, which hands them on
    rows = df.orderBy(*order).offset(offset).limit(size + 1).collect()
    page_rows = df.sparkSession.createDataFrame(rows[:size], df.schema)
    return page_rows, base64.b64encode(str(offset + size).encode()).decode() if len(rows) > size else None


def page_size(asked: int | None, default: int = 20, most: int = 100) -> int:
    """Rows of a page: the default if none are asked for, never below 1 or above ``most``."""
    return max(1, min(most, default if asked is None else asked))


def after(df: DataFrame, column: str, last, size: int) -> DataFrame:
    """The page of rows whose key follows ``last`` (null: the first page): no row before it is sorted."""
    rows = df if last is None else df.where(F.col(column) > F.lit(last))
    return rows.orderBy(column).limit(size)


def newest(df: DataFrame, time_col: str, tie: str, most: int, **equal) -> DataFrame:
    """The latest rows, the smaller ``tie`` first; columns equal to values that are not None."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.orderBy(F.desc_nulls_last(time_col), tie).limit(most)


def lookup(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with one of the keys, and the keys that no row has (their other columns null)."""
    return keys.select(*columns).distinct().join(df, columns, "left").select(*df.columns)


def name_search(df: DataFrame, column: str, word: str) -> DataFrame:
    """Rows whose name contains a word, whatever its case; a blank word finds all."""
    word = word.strip().lower()
    return df.where(F.contains(F.lower(column), F.lit(word))) if word else df


def documents_overview(history: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their numbers of chunks; documents without chunks count 0."""
    n = chunks.groupBy("collection", F.col("metadata")["source_path"].alias("source_path")).agg(F.countDistinct("chunk_id").alias("n_chunks"))
    return history.join(n, ["collection", "source_path"], "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def document_detail(documents: DataFrame, chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents with one of the keys (uuid), with their natural key and numbers of chunks; the UUID is computed and joined, not searched."""
    named = documents.withColumn("uuid", document_uuid(F.col("collection"), F.col("source_path"))).join(keys.select("uuid").distinct(), "uuid", "left_semi")
    return documents_overview(named, chunks)


def document_uuid(collection: Column, path: Column) -> Column:
    return ids.uuid5(ids.NAMESPACE_URL, F.concat(F.lit("document:"), collection, F.lit(":"), path))


def cascade(chunks: DataFrame, postings: DataFrame, vectors: DataFrame, history: DataFrame, doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without some documents (collection, source_path, doc_hash), and what was deleted of each document.

    Chunks are found by path or hash; postings and vectors (collection,
    chunk_id) go with them, history rows (collection, file_hash) with the document.
    """
    path = F.col("metadata")["source_path"]
    by_path = chunks.select("chunk_id", "collection", path.alias("source_path")).join(doomed, ["collection", "source_path"]).select("chunk_id", "collection", "doc_hash")
    by_hash = chunks.select("chunk_id", "collection", F.col("source_ref").alias("doc_hash")).join(doomed.select("collection", "doc_hash"), ["collection", "doc_hash"]).select("chunk_id", "collection", "doc_hash")
    hits = store.cut_lineage(by_path.unionByName(by_hash).distinct())  # used by all that follows
    gone = hits.select("collection", "chunk_id").distinct()
    left = {
        "chunks": chunks.join(gone, ["collection", "chunk_id"], "left_anti").select(*chunks.columns),
        "postings": postings.join(gone, ["collection", "chunk_id"], "left_anti").select(*postings.columns),
        "vectors": vectors.join(gone, ["collection", "chunk_id"], "left_anti").select(*vectors.columns),
        "history": history.join(doomed.select("collection", F.col("doc_hash").alias("file_hash")).distinct(), ["collection", "file_hash"], "left_anti").select(*history.columns),
    }
    count = lambda t, name: hits.join(t.select("collection", "chunk_id"), ["collection", "chunk_id"]).groupBy("collection", "doc_hash").agg(F.count("*").alias(name))
    totals = hits.groupBy("collection", "doc_hash").agg(F.count("*").alias("chunks"))
    for t, name in ((postings, "postings"), (vectors, "vectors")):
        totals = totals.join(count(t, name), ["collection", "doc_hash"], "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "postings", "vectors")]
    return left, totals.select("collection", "doc_hash", *zero).withColumn("total", F.col("chunks") + F.col("postings") + F.col("vectors"))


def marked(history: DataFrame, files: DataFrame, status: str, at: float) -> DataFrame:
    """History (collection, file_hash, status, updated_at) with files (collection, file_hash) marked; rows without a collection move to ``_default``."""
    moved = history.withColumn("collection", F.coalesce("collection", F.lit("_default")))
    fresh = files.select(F.coalesce("collection", F.lit("_default")).alias("collection"), "file_hash", F.lit(status).alias("status"), F.lit(at).alias("updated_at")).distinct()
    return upsert(moved.select("collection", "file_hash", "status", "updated_at"), fresh, ["collection", "file_hash"])


def delete_documents(chunks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks left after deleting documents (collection, source_path, doc_hash), and the number deleted of each.

    A chunk belongs to a document by its path or by its hash.
    """
    path = F.col("metadata")["source_path"]
    by_path = chunks.select("chunk_id", "collection", path.alias("source_path")).join(doomed, ["collection", "source_path"]).select("chunk_id", "collection", "doc_hash")
    by_hash = chunks.select("chunk_id", "collection", F.col("source_ref").alias("doc_hash")).join(doomed.select("collection", "doc_hash"), ["collection", "doc_hash"]).select("chunk_id", "collection", "doc_hash")
    hits = by_path.unionByName(by_hash).distinct()
    left = chunks.join(hits.select("chunk_id", "collection").distinct(), ["chunk_id", "collection"], "left_anti").select(*chunks.columns)
    return left, hits.groupBy("collection", "doc_hash").agg(F.count("*").alias("deleted"))


def new_files(incoming: DataFrame, history: DataFrame) -> DataFrame:
    """Files (collection, file_hash) that no successful run has seen."""
    done = history.where("status = 'success'").select("collection", "file_hash")
    return incoming.join(done, ["collection", "file_hash"], "left_anti")


def merged_names(indexed: DataFrame, configured: DataFrame) -> DataFrame:
    """Names in either table (``name``) with where they come from and how many rows of the first have them."""
    a, b = indexed.groupBy("name").agg(F.lit(1).alias("a"), F.count("*").alias("n")), configured.select("name", F.lit(1).alias("b")).distinct()
    source = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "index").otherwise("store")
    return a.join(b, "name", "full_outer").select("name", source.alias("source"), F.coalesce("n", F.lit(0)).alias("rows"))


def allowed_rows(df: DataFrame, grants: DataFrame, principal: str | None) -> DataFrame:
    """Rows of collections a principal was granted (key_id, collection); None sees all."""
    if principal is None:
        return df
    mine = grants.where(F.col("key_id") == principal).select("collection").distinct()
    return df.join(mine, "collection", "left_semi")


def query_collection(requested: Column, allowed: Column) -> Column:
    """Collection that a query asks: the one requested if it is allowed (null allows all), ``default`` if all are, else the only one allowed; null if none can be told."""
    free = allowed.isNull()
    chosen = F.when(free | F.array_contains(allowed, requested), requested)
    return F.when(requested.isNotNull(), chosen).when(free, F.lit("default")).when(F.size(allowed) == 1, F.element_at(allowed, 1))


def batch_limits(files: DataFrame, keys: list[str], most_files: int = 100, most_bytes: int = 2 << 30) -> DataFrame:
    """``keys..., files, bytes, ok`` of batches of uploads (size_bytes)."""
    n = files.groupBy(*keys).agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return n.withColumn("ok", (F.col("files") <= most_files) & (F.col("bytes") <= most_bytes))


def sanitised_metadata(metadata: Column) -> Column:
    """Map entries with a value that is not null or empty."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull() & (v != ""))


def admission(files: DataFrame, history: DataFrame, types: list[str], most_bytes: int = 30 * 1024 * 1024) -> DataFrame:
    """Uploads (file_no, collection, filename, size_bytes, file_hash) with status accepted, skipped or rejected and a code.

    Checks in order: type, size, name used earlier in the batch (among files that passed), hash already done.
    """
    kind = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    first = F.when(~kind.isin(types), "UNSUPPORTED_FILE_TYPE").when(F.col("size_bytes") > most_bytes, "FILE_TOO_LARGE")
    checked = files.withColumn("__first", first)
    w = Window.partitionBy("collection", "filename", F.col("__first").isNull()).orderBy("file_no")
    checked = checked.withColumn("__n", F.row_number().over(w))
    done = history.where("status = 'success'").select("collection", "file_hash", F.lit(True).alias("__done")).distinct()
    code = F.coalesce("__first", F.when(F.col("__n") > 1, "DUPLICATE_FILENAME"))
    status = F.when(code.isNotNull(), "rejected").when(F.col("__done"), "skipped").otherwise("accepted")
    return checked.join(done, ["collection", "file_hash"], "left").select(*files.columns, status.alias("status"), code.alias("code"))
