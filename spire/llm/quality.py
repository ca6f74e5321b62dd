"""Quality classifier by compression with good and bad dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, id_crc, sample_labels, sample_texts, spread

LEVEL = 3


def _cut(text: str | None, size: int) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i:i + size] for i in range(0, len(raw), size)]


def _compressor(dictionary: bytes):
    kind = zstandard.ZstdCompressionDict(dictionary)
    kind.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False)


def _features(texts: list[str | None], good, bad, chunk: int) -> np.ndarray:
    """Per text: normalised difference of the compressed sizes, both rates, log length.

    A text is compressed in pieces of ``chunk`` bytes, so that the dictionary
    counts as much at the end of a long text as at its start."""
    out = np.zeros((len(texts), 4))
    for i, t in enumerate(texts):
        parts = _cut(t, chunk)
        if parts:
            g = sum(len(good.compress(p)) for p in parts)
            b = sum(len(bad.compress(p)) for p in parts)
            n = sum(map(len, parts))
            out[i] = (b - g) / (b + g), g / n, b / n, np.log(n)
    return out


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float
    chunk: int

    def scorer(self):
        """A column function text -> score, run in Arrow batches."""
        model = self
        tools: list = []  # compressors live in the worker, not in the closure

        @F.arrow_udf("double")
        def score(text: pa.Array) -> pa.Array:
            if not tools and model.good:
                tools.extend((_compressor(model.good), _compressor(model.bad)))
            texts = text.to_pylist()
            p = np.full(len(texts), model.prior)
            if tools:
                z = spread(_features(texts, *tools, model.chunk), model.mean, model.scale) @ model.weights
                told = np.array([bool(t) for t in texts], bool)
                p = np.where(told, 1 / (1 + np.exp(-np.clip(z, -40, 40))), p)
            return pa.array(p)

        return score


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", dictionary_docs: int = 3000,
                calibration_docs: int = 6000, chunk: int = 2048, dictionary_bytes: int = 112_640, seed: int = 5) -> QualityModel:
    """Build two zstandard dictionaries and the calibration.

    The fit uses a bounded sample of labelled rows, the first in hash order:
    ``dictionary_docs`` a class give one piece of ``chunk`` bytes each to a
    dictionary; ``calibration_docs`` others a class give four numbers each to
    a logistic regression, weighted back to the class shares of the labels.
    An id gives one text, also where it repeats.
    ``labels(doc_id, <label>)`` must hold only rows that may be learnt from.
    Without enough labelled texts of either class the model says the share of
    good labels (0.5 without any) for every text.
    """
    spark = docs.sparkSession
    picked = sample_labels(labels, label, dictionary_docs + calibration_docs, seed)
    kinds = labels.where(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double")), F.count(F.lit(1))).first()
    prior = float(kinds[0]) if kinds[1] else 0.5
    texts = sample_texts(docs, picked, "quality-sample")
    half = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(dictionary_docs + calibration_docs)) < dictionary_docs
    pieces = F.floor((F.length("text") - 1) / chunk) + 1
    one = F.substring("text", F.pmod(F.col("h"), pieces).cast("int") * chunk + 1, F.lit(chunk))
    rows = texts.where(half).select("y", "h", one.alias("piece")).orderBy("h", "piece").limit(2 * dictionary_docs).collect()
    parts = {y: [p.encode()[:chunk] for kind, _, p in rows if kind == y] for y in (0, 1)}
    empty = np.zeros(4)
    flat = QualityModel(b"", b"", empty, empty + 1, np.zeros(15), prior, chunk)
    if min(map(len, parts.values())) < 8:
        return flat
    made = {y: zstandard.train_dictionary(min(dictionary_bytes, max(1024, sum(map(len, p)) // 2)), p, k=64, d=8, level=LEVEL).as_bytes()
            for y, p in parts.items()}

    def measure(batches):
        good, bad = _compressor(made[1]), _compressor(made[0])
        for batch in batches:
            f = _features(batch.column("text").to_pylist(), good, bad, chunk)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(f), pa.list_(pa.float64()))], ["y", "f"])

    found = texts.where(~half).select("text", "y").mapInArrow(measure, "y int, f array<double>").collect()
    y, x = np.array([r.y for r in found], float), np.array([r.f for r in found]).reshape(-1, 4)
    if len(set(y.tolist())) < 2:
        return flat
    mean, scale = x.mean(0), x.std(0) + 1e-9
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    return QualityModel(made[1], made[0], mean, scale, fit_logistic(spread(x, mean, scale), y, weight), prior, chunk)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Score every whole text of ``docs(doc_id, text)``.

    Labels are learnt only from rows whose crc32(doc_id as text) mod ``folds``
    is not ``held``; the score sees the text alone.  Returns doc_id, held_out,
    score (0 to 1, higher: good likelier) and predicted (score >= 0.5).  Null
    and empty texts score the share of good labels; a null id is not held
    out; equal texts score alike; repeated rows and extra columns are
    harmless; an empty table gives an empty result.
    """
    model = fit_quality(docs, labels.where(id_crc(F.col("doc_id")) % folds != held))
    return (docs.select("doc_id", F.coalesce(id_crc(F.col("doc_id")) % folds == held, F.lit(False)).alias("held_out"),
                        model.scorer()("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, below: float = 0.5) -> DataFrame:
    """Drop the documents that score under ``below``; the columns stay as they
    are.  Null and empty texts score the share of good labels."""
    model = fit_quality(docs, labels.where(id_crc(F.col("doc_id")) % folds != held))
    return docs.where(model.scorer()("text") >= below)
