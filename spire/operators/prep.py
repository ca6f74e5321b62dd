"""Collection and qrels preparation.

All set-oriented: semi/anti joins instead of Python membership tests,
dense row ids (R1) instead of enumerate().
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from .rowids import assign_row_ids


def collection_subset(docs: DataFrame, judged: DataFrame, frac: float = 0.01,
                      id_col: str = "doc_id", order: str | None = None) -> DataFrame:
    """The judged documents that exist, then distractors in file order
    (the first record is skipped, as a header) until the subset holds
    ``frac`` of the collection.  Returns ``(doc_id, kind)``."""
    order = order or id_col
    keep = docs.join(judged.select(F.col("did").alias(id_col)).distinct(), id_col, "left_semi")
    n_docs = docs.count()
    n_keep = keep.count()
    need = max(0, math.ceil(frac * n_docs - 1e-9) - n_keep)
    out = keep.select(id_col, F.lit("judged").alias("kind"))
    if need == 0:
        return out
    ranked = assign_row_ids(docs.select(id_col, order) if order != id_col else docs.select(id_col),
                            [order], out="_pos")
    cand = ranked.where(F.col("_pos") > 0).join(keep.select(id_col), id_col, "left_anti")
    cand = assign_row_ids(cand, ["_pos"], out="_c").where(F.col("_c") < need)
    return out.unionByName(cand.select(id_col, F.lit("distractor").alias("kind")))


def resolve_provenance(turns: DataFrame, docs: DataFrame, key: list[str],
                       prov: str = "provenance", id_col: str = "doc_id") -> DataFrame:
    """J4 + R7: keep only provenance ids present in the collection (order
    kept, duplicates kept), then drop turns left without any."""
    e = turns.select(*key, F.posexplode(prov).alias("_p", "_doc"))
    present = e.join(docs.select(F.col(id_col).alias("_doc")).distinct(), "_doc", "left_semi")
    kept = present.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_doc"))), lambda s: s["_doc"]).alias(prov))
    return turns.drop(prov).join(kept, key)


def filter_empty_relevance(turns: DataFrame, prov: str = "provenance") -> DataFrame:
    """Drop turns without truth passages."""
    return turns.where(F.size(prov) > 0)


def map_qrels_to_rows(qrels: DataFrame, query_ids: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """External query and document ids -> row ids; unknown ids dropped.
    ``query_ids``/``doc_ids`` are ``(row_id, id)`` maps.  A ``line`` column
    (place in the file) is kept."""
    q = query_ids.select(F.col("id").alias("qid"), F.col("row_id").alias("q_row"))
    d = doc_ids.select(F.col("id").alias("did"), F.col("row_id").alias("d_row"))
    return qrels.join(q, "qid").join(d, "did").select(
        F.col("q_row").alias("qid"), F.col("d_row").alias("did"), "rel", *[c for c in qrels.columns if c == "line"])


def lookup_answer(queries: DataFrame, docs: DataFrame, answer_id: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Canonical answer text by id; missing -> ''."""
    d = docs.select(F.col(id_col).alias(answer_id), F.col(text_col).alias("answer"))
    return queries.join(d, answer_id, "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def align_by_position(left: DataFrame, right: DataFrame, order_left: list, order_right: list) -> DataFrame:
    """I-th row of one table with the i-th of the other (for inputs
    without ids); both sides get dense row ids first."""
    a = assign_row_ids(left, order_left, out="_i")
    b = assign_row_ids(right, order_right, out="_i")
    return a.join(b, "_i")


def first_entries(rewrites: DataFrame, keys: list[str] | str = "row_id", text_col: str = "text",
                  out: str = "text") -> DataFrame:
    """Ids and the trimmed current question (the first [SEP] part)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return rewrites.select(*keys, strip_ws(F.element_at(F.split(text_col, r"\[SEP\]"), 1)).alias(out))
