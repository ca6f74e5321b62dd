"""Inverted index: build, persist, shard, route, merge (X5, X6, X10, X11,
A12, A13, A16, J12, W12, W13, K4, K5, K9, S18; `index_files` for an index
that describes itself).

The index *is* the long postings table ``(did, dim, weight)``.  On disk it
is bucketed by document id and sorted by dim inside each bucket: a dot
product is local to a document, so a scan of the bucketed table satisfies
the ``(qid, did)`` aggregation's distribution and no exchange sits between
scan and aggregate.  It is never shuffled on ``dim`` (hot dimensions).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import retrieve as R
from .rowids import assign_row_ids
from .sparse import prune_topk, sparsity_stats

DEFAULT_BUCKETS = 64


def build_index(vectors: DataFrame, ids: DataFrame, id_col: str, order: list | None = None,
                dim_voc: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Encoded vectors -> (postings on dense row ids, id map, stats).

    ``ids`` lists every document (also those without non-zero weight) once: a
    repeated id is an error that names some.  Row ids follow ``order``
    (default: the id)."""
    check_unique(ids, id_col)
    id_map = assign_row_ids(ids.select(id_col), order or [id_col])
    postings = vectors.where(F.col("weight") > 0).join(id_map, id_col) \
        .select(F.col("row_id").alias("did"), "dim", F.col("weight").cast("float").alias("weight"))
    kw = {"dim_voc": dim_voc} if dim_voc else {}
    stats = sparsity_stats(vectors, ids, id_col, **kw)
    return postings, id_map.select("row_id", F.col(id_col).alias("id")), stats


def check_unique(ids: DataFrame, id_col: str, show: int = 10) -> None:
    """SURVEY 2.0: ids of a collection are unique; raises with examples."""
    twice = [r[0] for r in ids.groupBy(id_col).count().where("count > 1").select(id_col).limit(show).collect()]
    if twice:
        raise ValueError(f"repeated ids in {id_col}: {twice}")


def write_postings(postings: DataFrame, path: str, table: str, buckets: int = DEFAULT_BUCKETS) -> None:
    """K4: bucketed by document, sorted by dim inside a bucket.  Bucketing
    needs a catalog entry; the files live at ``path`` (shared storage)."""
    # one task per bucket, so one file per bucket
    postings.repartition(buckets, "did").write.mode("overwrite").bucketBy(buckets, "did").sortBy("dim") \
        .option("path", path).saveAsTable(table)


def read_postings(spark: SparkSession, table: str) -> DataFrame:
    """The bucketed postings table."""
    return spark.table(table)


def reload_postings(spark: SparkSession, path: str, table: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """S18 in a later application: name the files at ``path`` (written by
    `write_postings` with the same number of buckets) in this session's catalog
    again, buckets included, so that scans stay clustered by document."""
    schema = spark.read.parquet(path).schema
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING parquet CLUSTERED BY (did) SORTED BY (dim) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def write_id_map(id_map: DataFrame, path: str) -> None:
    """K5: internal row id -> external id."""
    id_map.write.mode("overwrite").parquet(path)


def posting_arrays(postings: DataFrame, block: int = 100_000) -> DataFrame:
    """A16 export form: per dimension, ``(did, weight)`` arrays in document
    order, cut into blocks of at most ``block`` documents so a hot
    dimension never becomes one unbounded array."""
    b = F.floor(F.col("did") / F.lit(block)).alias("block")
    return postings.groupBy("dim", b).agg(
        F.array_sort(F.collect_list(F.struct("did", "weight"))).alias("postings"))


def posting_distribution(lengths: DataFrame) -> DataFrame:
    """Posting lengths in decreasing order with a 0-based rank (R1,
    no global window)."""
    r = assign_row_ids(lengths.select("dim", "df"), [F.col("df").desc(), F.col("dim").asc()], out="rank")
    return r.select(F.col("rank").cast("long"), "dim", F.col("df").cast("long"))


def shard_documents(vec: DataFrame, id_col: str, n_shards: int, topk_dims: int = 100,
                    ids: DataFrame | None = None) -> DataFrame:
    """shard = (sum of the ids of the ``topk_dims`` strongest dims) mod n.
    Token dimensions count by their crc32.  With ``ids`` (all documents) those
    without weights go to shard 0."""
    top = prune_topk(vec, topk_dims, id_col)
    number = F.col("dim") if dict(vec.dtypes)["dim"] != "string" else F.crc32(F.col("dim").cast("binary"))
    found = top.groupBy(id_col).agg(F.pmod(F.sum(number), F.lit(n_shards)).cast("int").alias("shard"))
    if ids is None:
        return found
    return ids.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("shard", F.lit(0)).alias("shard"))


def shard_top_dims(vec: DataFrame, shards: DataFrame, id_col: str, topk_dims: int = 100) -> DataFrame:
    """Sorted union of the members' top dims per shard.  The
    set is bounded by the vocabulary and built map-side."""
    top = prune_topk(vec, topk_dims, id_col).join(shards, id_col)
    return top.groupBy("shard").agg(F.array_sort(F.collect_set("dim")).alias("top_dims"))


def route(q_terms: DataFrame, shard_dims: DataFrame, m: int, qid: str = "qid") -> DataFrame:
    """J12 + U5 + T4: overlap of a query's dims with each shard's top dims;
    the best ``m`` shards with overlap > 0 (ties by shard id).

    Overlap is the dot product of presence weights, so shards are scored like
    documents: the shard sets are the postings, clustered by shard, and the
    queries go over them in measured blocks, never shuffled on a dimension."""
    sd = shard_dims.select("shard", F.explode("top_dims").alias("dim"), F.lit(1.0).alias("weight"))
    q = q_terms.select(qid, "dim", F.lit(1.0).alias("weight"))
    ov = R.score(q, sd, qid, "shard").select(qid, "shard", F.col("score").cast("long").alias("overlap"))
    w = Window.partitionBy(qid).orderBy(F.col("overlap").desc(), F.col("shard").asc())
    return ov.where(F.col("overlap") > 0).withColumn("srank", F.row_number().over(w)) \
        .where(F.col("srank") <= m)


def shard_dim_words(vec: DataFrame, shards: DataFrame, id_col: str, topk_dims: int = 100) -> DataFrame:
    """A12 as bitmaps: ``(shard, word, bits)``, bit i of a word says that
    dimension ``64 * word + i`` is among a member's top dims.  For integer
    dimensions; combined map-side, a 64th of the rows of the sets, and no shard
    comes as one array of its vocabulary."""
    return _dim_words(prune_topk(vec, topk_dims, id_col).join(shards, id_col), "shard")


def _dim_words(terms: DataFrame, key: str) -> DataFrame:
    return terms.groupBy(key, F.shiftright("dim", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(dim & 63 AS int))")).alias("bits"))


def route_words(q_terms: DataFrame, words: DataFrame, m: int, qid: str = "qid") -> DataFrame:
    """J12 + U5 + T4 over `shard_dim_words`: the rows of `route`.  A query's
    dims are words too; the overlap is the number of bits of the
    intersections.  Queries go over the shards' words in measured blocks."""
    q = _dim_words(q_terms, qid).withColumnRenamed("bits", "_q")
    blocks = R.query_blocks(q, qid)
    by_shard = R.clustered(words, "shard", len(blocks))
    w = Window.partitionBy(qid).orderBy(F.col("overlap").desc(), F.col("shard").asc())
    runs = []
    for part, fits in blocks:
        overlap = by_shard.join(F.broadcast(part) if fits else part, "word").groupBy(qid, "shard").agg(
            F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("_q")))).cast("long").alias("overlap"))
        runs.append(overlap.where("overlap > 0").withColumn("srank", F.row_number().over(w)).where(F.col("srank") <= m))
    return R.united(runs)


def shard_postings(postings: DataFrame, shards: DataFrame, did: str = "did") -> DataFrame:
    """K9 layout: postings tagged with their document's shard (written with
    ``partitionBy('shard')`` so routed retrieval prunes partitions)."""
    return postings.join(shards.select(did, "shard"), did)


def write_sharded_postings(tagged: DataFrame, path: str) -> None:
    """K9: one folder per shard, global ids, gzip parquet."""
    tagged.write.mode("overwrite").partitionBy("shard").option("compression", "gzip").parquet(path)


def retrieve_sharded(q_terms: DataFrame, routed: DataFrame, tagged_postings: DataFrame,
                     k: int = 1000, threshold: float | None = 0.0, qid: str = "qid",
                     did: str = "did", digits: int | None = None) -> DataFrame:
    """X11: each query term is expanded to the query's routed shards and
    joined on (dim, shard): a document outside those shards is never
    scored.  With postings partitioned by shard on disk the join prunes
    whole folders."""
    qs = q_terms.join(routed.select(qid, "shard"), qid)
    return R.retrieve(qs, tagged_postings, k, threshold, qid, did, digits=digits, extra_keys=["shard"])


def retrieve_shard_folders(spark: SparkSession, q_terms: DataFrame, routed: DataFrame, path: str, k: int = 1000, threshold: float | None = 0.0,
                           qid: str = "qid", did: str = "did", digits: int | None = None) -> DataFrame:
    """X11 over the folders of `write_sharded_postings`: the shards in the
    broadcast query terms become a runtime filter of the scan (dynamic partition
    pruning), so folders that no query is routed to are not opened."""
    reached = routed.where(F.col("shard").isNotNull() & (F.col("srank") >= 1))
    return retrieve_sharded(q_terms, reached, spark.read.parquet(path), k, threshold, qid, did, digits)


def shard_offsets(sizes: DataFrame) -> DataFrame:
    """Exclusive running sum of shard sizes in numeric shard order
    (one row per shard, so a global window is fine)."""
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def local_indexes(vec: DataFrame, shards: DataFrame, id_col: str) -> DataFrame:
    """Per-shard indexes as produced by independent indexing jobs:
    ``(shard, local_id, id, dim, weight)`` with local ids 0.. per shard."""
    ids = assign_row_ids(shards.select(id_col, "shard"), [id_col], group=["shard"], out="local_id")
    return vec.join(ids, id_col)


def merge_index(parts: DataFrame, id_col: str, id_maps: DataFrame | None = None) -> DataFrame:
    """X6 = W13 + U2: local ids shifted by the shard offsets into one global
    id space.  A shard is as large as its id map, ``id_maps(shard, local_id,
    ...)``, which also lists documents without postings; without it, as its
    largest local id says."""
    sizes = (id_maps if id_maps is not None else parts).groupBy("shard").agg((F.max("local_id") + 1).alias("n"))
    offs = shard_offsets(sizes).select("shard", "offset")  # one row per shard
    return parts.join(offs, "shard").select(
        (F.col("local_id") + F.col("offset")).alias("row_id"), id_col, "dim", "weight")


def write_shard_index(vec: DataFrame, ids: DataFrame, path: str, id_col: str) -> None:
    """One shard indexed on its own: ``path/postings`` and ``path/ids`` with
    local row ids 0.. (all documents, also those without weights)."""
    postings, id_map, _ = build_index(vec, ids, id_col)
    write_id_map(id_map.select(F.col("row_id").alias("local_id"), "id"), f"{path}/ids")
    postings.select(F.col("did").alias("local_id"), "dim", "weight").write.mode("overwrite").parquet(f"{path}/postings")


def merge_written(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Separately written shard indexes -> (postings, id map) with global
    row ids, shards in the order of ``paths``."""
    def read(part):
        frames = [spark.read.parquet(f"{p}/{part}").withColumn("shard", F.lit(i)) for i, p in enumerate(paths)]
        return reduce(DataFrame.unionByName, frames)
    ids, posts = read("ids"), read("postings")
    offs = shard_offsets(ids.groupBy("shard").agg((F.max("local_id") + 1).alias("n"))).select("shard", "offset")
    moved = (F.col("local_id") + F.col("offset")).alias
    return (posts.join(offs, "shard").select(moved("did"), "dim", "weight"),
            ids.join(offs, "shard").select(moved("row_id"), "id"))


def merge_stats(stats: DataFrame) -> DataFrame:
    """Document-weighted mean of the per-shard L0/L1 statistics (the
    exact whole-index value, unlike an unweighted mean of means)."""
    n = F.col("n_docs").cast("double")
    return stats.agg((F.sum(F.col("l0") * n) / F.sum(n)).alias("l0"),
                     (F.sum(F.col("l1") * n) / F.sum(n)).alias("l1"),
                     F.sum("n_docs").alias("n_docs"))
