"""Sparse representations: encode, pool, prune, normalise, index statistics.

A sparse vector table is long: one row per non-zero ``(id, dim, weight)``.
Integer ``dim`` for model vocabularies; the lexical encoder uses the term
itself as the dimension (an open vocabulary), which every operator here
accepts because ``dim`` is only ever compared for equality.

Rows of one vector are bounded by the vocabulary, so per-vector windows
(prune, normalise) never build an unbounded group.  Nothing here shuffles
on ``dim`` except the per-dimension statistics, which aggregate map-side
first (a hot dimension is one partial sum per task, not one task).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import L2_EPS, activation
from .layout import cluster

# BERT's vocabulary width, the reference's default dimension count.
DEFAULT_DIM_VOC = 30522
# tokeniser used by the built-in lexical encoder: lower case, split on any
# run of characters that are neither letters nor digits
# texts and characters that a model callable gets at once
ENCODE_ROWS, ENCODE_CHARS = 512, 1 << 20
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def dense_to_sparse(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    activate: bool = True, out_id: str | None = None) -> DataFrame:
    """Token-free encoder path: one array of logits per id -> non-zero
    ``(id, dim, weight)`` with F13 applied (``log1p(relu(x))``)."""
    out_id = out_id or id_col
    exploded = df.select(F.col(id_col).alias(out_id), F.posexplode(vec_col).alias("dim", "x"))
    w = activation("x") if activate else F.col("x").cast("double")
    return exploded.select(out_id, F.col("dim").cast("int").alias("dim"), w.alias("weight")) \
        .where(F.col("weight") > 0)


def pool(tokens: DataFrame, how: str = "max", id_col: str = "doc_id") -> DataFrame:
    """A2: token activations ``(id, pos, dim, logit, mask)`` -> one vector.

    ``max`` / ``sum`` pool F13 over positions; ``cls`` keeps position 0."""
    act = activation("logit", "mask").alias("a")
    t = tokens.select(id_col, "pos", "dim", act)
    if how == "cls":
        t = t.where(F.col("pos") == 0)
        agg = F.max("a")
    elif how == "max":
        agg = F.max("a")
    elif how == "sum":
        agg = F.sum("a")
    else:
        raise ValueError(f"unknown pooling {how!r}")
    return t.groupBy(id_col, "dim").agg(agg.alias("weight")).where(F.col("weight") > 0)


def pool_dense(hidden: DataFrame, how: str = "mean", id_col: str = "doc_id") -> DataFrame:
    """A3: hidden states ``(id, pos, h ARRAY<DOUBLE>, mask)`` -> ``(id, dim, value)``
    by masked mean over positions, or the first position (``cls``)."""
    e = hidden.select(id_col, "pos", "mask", F.posexplode("h").alias("dim", "x"))
    if how == "cls":
        return e.where(F.col("pos") == 0).select(id_col, "dim", F.col("x").cast("double").alias("value"))
    if how != "mean":
        raise ValueError(f"unknown pooling {how!r}")
    return e.groupBy(id_col, "dim").agg(
        (F.sum(F.col("x") * F.col("mask")) / F.sum("mask")).alias("value"))


def tokenize(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole-text lexical tokens ``(id, token)`` (one row per occurrence).

    Texts are clustered by id first (free when the collection already is):
    the per-document term counts then aggregate without an exchange, and
    the resulting postings are already clustered by document for
    retrieval — one shuffle of text instead of two shuffles of tokens."""
    df = cluster(df.select(id_col, text_col), [id_col])
    return df.select(id_col, F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("token")) \
        .where(F.col("token") != "")


def bag_of_words(tokens: DataFrame, id_col: str, token_col: str = "token",
                 value_col: str | None = None, special: list | None = None) -> DataFrame:
    """Binary set of tokens per id (weight 1), or the given values;
    special tokens removed."""
    t = tokens
    if special:
        t = t.where(~F.col(token_col).isin(special))
    if value_col is None:
        return t.select(id_col, F.col(token_col).alias("dim")).distinct() \
            .withColumn("weight", F.lit(1.0))
    return t.groupBy(id_col, F.col(token_col).alias("dim")).agg(F.max(value_col).cast("double").alias("weight"))


def lexical_encode(df: DataFrame, id_col: str, text_col: str, kind: str = "doc") -> DataFrame:
    """X1 built-in encoder: documents get ``log1p(tf)``, queries a binary bag
    of words (X2).  Tokens are the dimensions."""
    toks = tokenize(df, id_col, text_col)
    if kind == "query":
        return bag_of_words(toks, id_col)
    return toks.groupBy(id_col, F.col("token").alias("dim")).agg(
        F.log1p(F.count(F.lit(1)).cast("double")).alias("weight"))


def _few_texts(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of a batch in parts of few texts, a long text on its own."""
    start = chars = 0
    for i, text in enumerate(pdf.iloc[:, 1]):
        size = len(text or "")
        if i > start and (i - start >= ENCODE_ROWS or chars + size > ENCODE_CHARS):
            yield pdf.iloc[start:i]
            start, chars = i, 0
        chars += size
    if len(pdf):
        yield pdf.iloc[start:]


def encode(df: DataFrame, encoder: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
           id_col: str = "id", text_col: str = "text",
           schema: str | None = None) -> DataFrame:
    """X1 with a model callable: Arrow batches of ``(id, text)`` in, rows of
    ``(id, dim, weight)`` out, via ``mapInPandas``; zero weights dropped.  The
    model gets at most ``ENCODE_ROWS`` texts and about ``ENCODE_CHARS``
    characters at once, so what it returns for them stays small."""
    schema = schema or f"{id_col} bigint, dim int, weight double"

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return encoder(part for pdf in batches for part in _few_texts(pdf))

    return df.select(id_col, text_col).mapInPandas(bounded, schema).where(F.col("weight") > 0)


def mask_lexical(vec: DataFrame, tokens_bow: DataFrame, id_col: str) -> DataFrame:
    """Keep only dimensions present in the text's own bag of words
    (a semi join on ``(id, dim)``)."""
    return vec.join(tokens_bow.select(id_col, "dim"), [id_col, "dim"], "left_semi")


def prune_topk(vec: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k largest weights of each vector (ties by dim); k <= 0
    disables pruning."""
    if k is None or k <= 0:
        return vec
    w = Window.partitionBy(id_col).orderBy(F.col("weight").desc(), F.col("dim").asc())
    return vec.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def encode_topk(vec: DataFrame, id_col: str, top: int) -> DataFrame:
    """W8 applied after pooling."""
    return prune_topk(vec, top, id_col)


def l2_normalize(vec: DataFrame, id_col: str, eps: float = L2_EPS) -> DataFrame:
    """``x / (||x|| + eps)`` per vector (cosine mode)."""
    w = Window.partitionBy(id_col)
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(w))
    return vec.withColumn("weight", F.col("weight") / (norm + F.lit(eps)))


def posting_lengths(postings: DataFrame, dim_voc: int | None = None) -> DataFrame:
    """Document frequency per dimension; with ``dim_voc`` every
    dimension 0..dim_voc-1 appears, zero-filled."""
    df = postings.groupBy("dim").agg(F.count(F.lit(1)).alias("df"))
    if dim_voc is None:
        return df
    spark = postings.sparkSession
    dims = spark.range(dim_voc).select(F.col("id").cast("int").alias("dim"))
    return dims.join(df, "dim", "left").select("dim", F.coalesce("df", F.lit(0)).cast("long").alias("df"))


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two single-row aggregates (both sides have exactly one row)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def sparsity_stats(vec: DataFrame, ids: DataFrame, id_col: str, dim_voc: int = DEFAULT_DIM_VOC,
                   keys: list[str] | None = None) -> DataFrame:
    """Exact per-document mean of L0 (non-zeros), L1 (sum |w|) and the
    sparsity ratio ``1 - L0 / dim_voc`` (per ``keys`` group, e.g. shard).
    Documents without any non-zero weight count as 0: the id map, not the
    postings, defines N."""
    keys = list(keys or [])
    per_doc = vec.groupBy(*keys, id_col).agg(F.count(F.lit(1)).alias("l0"), F.sum(F.abs("weight")).alias("l1"))
    full = ids.select(*keys, id_col).join(per_doc, keys + [id_col], "left") \
        .select(*keys, F.coalesce("l0", F.lit(0)).alias("l0"), F.coalesce("l1", F.lit(0.0)).alias("l1"))
    return full.groupBy(*keys).agg(F.avg("l0").alias("l0"), F.avg("l1").alias("l1"),
                                   (1 - F.avg("l0") / F.lit(float(dim_voc))).alias("sparsity"),
                                   F.count(F.lit(1)).alias("n_docs"))


def flops_regularizer(vec: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``sum_dim (mean_doc |w|)^2`` over all N documents."""
    s = vec.groupBy("dim").agg(F.sum(F.abs("weight")).alias("s")) \
        .agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    return _one_row_join(s, n).select(
        (F.coalesce("s2", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))).alias("flops"))


def retrieval_flops(d_vec: DataFrame, d_ids: DataFrame, d_id: str,
                    q_vec: DataFrame, q_ids: DataFrame, q_id: str) -> DataFrame:
    """Expected multiply-adds per (query, document) pair,
    ``sum_dim p_d(dim) * p_q(dim)`` with p = df / collection size."""
    dd = posting_lengths(d_vec).withColumnRenamed("df", "df_d")
    qd = posting_lengths(q_vec).withColumnRenamed("df", "df_q")
    s = dd.join(qd, "dim").agg(F.sum(F.col("df_d").cast("double") * F.col("df_q")).alias("s"))
    n = _one_row_join(d_ids.agg(F.count(F.lit(1)).alias("n_d")), q_ids.agg(F.count(F.lit(1)).alias("n_q")))
    return _one_row_join(s, n).select(
        (F.coalesce("s", F.lit(0.0)) / (F.col("n_d").cast("double") * F.col("n_q"))).alias("flops"))


def anti_zero(q_vec: DataFrame, d_vec: DataFrame) -> DataFrame:
    """``1/(sum q)^2 + 1/(sum d)^2`` over a batch of vectors."""
    q = q_vec.agg(F.sum("weight").alias("sq"))
    d = d_vec.agg(F.sum("weight").alias("sd"))
    return _one_row_join(q, d).select(
        (1 / (F.col("sq") * F.col("sq")) + 1 / (F.col("sd") * F.col("sd"))).alias("anti_zero"))


#: regularizers by name, as a configuration names them
REGULARIZERS = {"flops": flops_regularizer, "l0_l1": sparsity_stats, "anti_zero": anti_zero}


def regularizer(name: str):
    """The regularizer of that name; an unknown name is an error that lists the known."""
    if name not in REGULARIZERS:
        raise ValueError(f"unknown regularizer {name!r}; known: {', '.join(REGULARIZERS)}")
    return REGULARIZERS[name]
