"""Dense retrieval by blocks of vectors.

Vectors are packed, some hundred a row, as the bytes of one matrix.  Each block
of documents meets each block of queries, one matrix product gives all their
scores, and a task holds the best ``k`` documents of each query in what it has
read; they leave it at its end, or when it holds many.  The usual top-k merges them.  Queries come in blocks whose size is measured and
stays under the broadcast limit, so documents are read once per such block and
never shuffled; what is shuffled is at most ``k`` rows per query and task.  Exact: every query is scored against every document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import retrieve as R
from .products import Best

#: bytes of one matrix, and documents held for the queries of a task before they leave it
BLOCK_BYTES = 512 << 10
MOST_HELD = 2_000_000


def _matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a vector, and these as a matrix: null components are
    zero, shorter vectors end in zeros."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.flatnonzero(sizes)
    flat = pc.fill_null(vectors.flatten(), 0).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(rows), width), flat.dtype)
    out[np.arange(width)[None, :] < sizes[rows, None]] = flat
    return rows, out


def vector_blocks(df: DataFrame, id_col: str, vec_col: str, side: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df(id, array of numbers)`` as rows of many vectors: ids, the bytes of
    their matrix, its width.  Null and empty vectors are left out."""
    item = df.schema[vec_col].dataType.elementType
    number = "float" if isinstance(item, T.FloatType) else "double"
    kind = "float32" if number == "float" else "float64"
    schema = T.StructType([T.StructField(f"{side}_ids", T.ArrayType(df.schema[id_col].dataType)), T.StructField(f"{side}_data", T.BinaryType()),
                           T.StructField(f"{side}_width", T.IntegerType())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            rows, matrix = _matrix(vectors)
            step = max(1, block_bytes // max(1, matrix.shape[1] * matrix.itemsize))
            for a in range(0, len(rows), step):
                part = matrix[a:a + step]
                own = ids.take(pa.array(rows[a:a + step]))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                                                  pa.array([part.astype(kind).tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int32())],
                                                 names=[f"{side}_ids", f"{side}_data", f"{side}_width"])

    return df.select(id_col, F.col(vec_col).cast(f"array<{number}>")).mapInArrow(pack, schema)


def _best(k: int, digits: int | None, tie: str, kinds: tuple[str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(batch, side, i):
            width = batch.column(f"{side}_width")[i].as_py()
            return np.frombuffer(batch.column(f"{side}_data")[i].as_buffer(), kinds[side == "d"]).reshape(-1, width).astype(np.float64, copy=False)

        held: dict[int, tuple[Best, pa.Array]] = {}  # by block of queries
        for batch in batches:
            numbers = batch.column("q_no").to_pylist()
            for i in range(batch.num_rows):
                q, d = matrix(batch, "q", i), matrix(batch, "d", i)
                if numbers[i] not in held:
                    held[numbers[i]] = Best(len(q), k, digits, tie), pa.concat_arrays([batch.column("q_ids")[i].values])
                best = held[numbers[i]][0]
                width = min(q.shape[1], d.shape[1])
                with np.errstate(invalid="ignore", over="ignore"):
                    scores = q[:, :width] @ d[:, :width].T
                order = np.where(np.isnan(scores), np.inf, scores)
                floor = best.cut - best.slack(best.cut)
                if len(d) > k and not np.isfinite(floor).all():
                    kth = np.partition(order, len(d) - k, axis=1)[:, len(d) - k]
                    floor = np.fmax(floor, kth - best.slack(kth))
                at, of = np.nonzero((order >= floor[:, None]) | np.isinf(scores))
                best.add(at, scores[at, of], batch.column("d_ids")[i].values.take(pa.array(of)))
            if sum(b.held for b, _ in held.values()) > MOST_HELD:
                yield from (b.batch(ids) for b, ids in held.values() if b.held)
                held.clear()
        yield from (b.batch(ids) for b, ids in held.values() if b.held)
    return run


def dense_retrieve(queries: DataFrame, docs: DataFrame, k: int, qid: str = "qid", did: str = "did", vec_col: str = "embedding",
                   tie: str = "asc", digits: int | None = None, query_bytes: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` documents of greatest dot product for every query:
    ``(qid, did, score, rank)``, ties by document id.

    A null component counts as zero, and so do positions that only one of two
    vectors has; null and empty vectors take no part.  ``digits`` rounds the
    scores before they are compared, as in `retrieve.topk`."""
    blocks = R.query_blocks(queries.select(qid, vec_col), qid, query_bytes)
    d = vector_blocks(docs, did, vec_col, "d", block_bytes)
    number = tuple("float32" if isinstance(x.schema[vec_col].dataType.elementType, T.FloatType) else "float64" for x in (queries, docs))
    schema = T.StructType([T.StructField("q", queries.schema[qid].dataType), T.StructField("d", docs.schema[did].dataType), T.StructField("score", T.DoubleType())])
    find = _best(k, digits, tie, number)
    runs = []
    for part, fits in blocks:
        q = vector_blocks(part, qid, vec_col, "q", block_bytes).withColumn("q_no", F.monotonically_increasing_id())
        # every query with every document, by blocks
        scores = d.crossJoin(F.broadcast(q) if fits else q).mapInArrow(find, schema).toDF(qid, did, "score")
        runs.append(R.topk(scores, k, qid, did, tie=tie, digits=digits))
    return R.united(runs)
