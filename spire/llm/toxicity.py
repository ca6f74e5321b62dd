"""Toxicity by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, id_crc, sample_labels, sample_texts, spread

#: a token: a run of letters, in lower case
TOKEN = re.compile(r"[^\W\d_]+")
#: a token falls back on these prefixes (marked *) where it was seen too little
STEMS = (3, 5)


def _units(token: str) -> list[str]:
    """From the most general to the token itself."""
    return [token[:k] + "*" for k in STEMS] + [token]


def _log_odds(unit_counts: dict[str, tuple[int, int]], root: float, strength: float) -> dict[str, float]:
    """Signed log-odds of every counted unit (texts, toxic texts) against the
    overall toxic share.  The Dirichlet prior of a unit has ``strength``
    pseudo-counts and the share of its shorter prefix as mean."""
    share: dict[str, float] = {}

    def of(unit: str, parent: float) -> float:
        if unit not in share:
            n, t = unit_counts.get(unit, (0, 0))
            share[unit] = (t + strength * parent) / (n + strength)
        return share[unit]

    out, base = {}, math.log(root / (1 - root))
    for unit in unit_counts:
        p, stem = root, unit.rstrip("*")
        chain = [stem[:k] + "*" for k in STEMS if k <= len(stem)] if unit.endswith("*") else _units(unit)
        for u in chain:
            p = of(u, p)
        out[unit] = math.log(p / (1 - p)) - base
    return out


class _Scores(dict):
    """Scores of tokens: their log-odds, those of the longest counted prefix
    where the token itself was seen too little to be counted, or none, less
    the drift."""

    def __init__(self, odds: dict[str, float], drift: float):
        super().__init__()
        self.odds, self.drift = odds, drift

    def __missing__(self, token: str) -> float:
        found = next((self.odds[u] for u in reversed(_units(token)) if u in self.odds), 0.0)
        self[token] = found - self.drift
        return self[token]

    def of(self, tokens: list[str]) -> np.ndarray:
        """Of a token that repeats at once only the first counts; the others are drift."""
        out = np.fromiter(map(self.__getitem__, tokens), float, len(tokens))
        again = [i for i, (a, b) in enumerate(zip(tokens, tokens[1:]), 1) if a == b]
        out[again] = -self.drift
        return out


def _segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) in linear time.

    Positive runs come from left to right.  A run looks for the nearest
    segment on the stack that starts at a lower prefix sum; if that ends lower
    than the run, both and all between become one segment, which looks again;
    else the run is a segment of its own so far.  ``back`` remembers for each
    segment where its own search ended, so no pair is looked at twice."""
    up = np.concatenate(([False], scores > 0, [False]))
    edge = np.flatnonzero(up[1:] != up[:-1])
    if not len(edge):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    low, high, first, last, back = [], [], [], [], []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        lo, hi, start = total[a], total[b], a
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= lo:
                j = back[j]
            if j < 0 or high[j] >= hi:
                break
            lo, start, j, cut = low[j], first[j], back[j], j
            del low[cut:], high[cut:], first[cut:], last[cut:], back[cut:]
        low.append(lo)
        high.append(hi)
        first.append(start)
        last.append(b - 1)
        back.append(j)
    return [(float(h - x), a, b) for x, h, a, b in zip(low, high, first, last)]


@dataclass
class ToxicityModel:
    odds: dict[str, float]
    drift: float
    rate: float          # lambda of the extreme-value law of the best score in clean texts
    offset: float        # its log K
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def passages(self, text: str | None) -> list[tuple[float, float, int, int]]:
        """Significant passages: (expected chance count, score, first, last token)."""
        tokens = TOKEN.findall((text or "").lower())
        room = math.log(len(tokens) + 1)
        found = [(math.exp(min(50.0, self.offset + room - self.rate * s)), s, a, b) for s, a, b in _segments(_Scores(self.odds, self.drift).of(tokens))]
        return [x for x in found if x[0] < 1.0]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: best score in extreme-value units, evidence of all
        significant passages, their number, log length."""
        out, scores = np.zeros((len(texts), 4)), _Scores(self.odds, self.drift)
        for i, t in enumerate(texts):
            tokens = TOKEN.findall((t or "").lower())
            room = math.log(len(tokens) + 1)
            bits = [self.rate * s - room - self.offset for s, _, _ in _segments(scores.of(tokens))]
            strong = [b for b in bits if b > 0]
            out[i] = max(bits, default=-room - self.offset), math.log1p(sum(strong)), math.log1p(len(strong)), room
        return out

    def scorer(self):
        model = self

        @F.arrow_udf("double")
        def score(text: pa.Array) -> pa.Array:
            texts = text.to_pylist()
            if not model.odds:
                return pa.array(np.full(len(texts), model.prior))
            z = spread(model.features(texts), model.mean, model.scale) @ model.weights
            return pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 12_000, strength: float = 8.0,
                 few: int = 3, drift: float = 1.0, seed: int = 7) -> ToxicityModel:
    """Learn log-odds and calibration from a bounded sample of labelled rows.

    The first ``rows`` labelled ids a class in hash order, one text each; units
    are counted once a text, clean and toxic texts alike; each half of the
    texts calibrates with the counts of the other.  Spark counts; units that
    at least ``few`` texts of the sample have come to the driver, a number
    bounded by the sample; tokens under that count score by their prefix.
    ``drift`` is taken off every token, so that chance runs end.  The law of the
    best score in clean texts (Gumbel, by moments) turns scores into expected
    chance counts; a logistic regression, weighted to the class shares of all
    labels, turns these into a probability.  ``labels`` must hold only rows that
    may be learnt from.  Without texts of both classes every text scores the
    share of toxic labels (0 without any).
    """
    picked = sample_labels(labels, label, rows, seed)
    kinds = labels.where(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double")), F.count(F.lit(1))).first()
    prior = float(kinds[0]) if kinds[1] else 0.0
    texts = (sample_texts(docs, picked, "toxicity-sample")
             .withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)).cast("int")))

    def count(batches):
        for batch in batches:
            unit, toxic, part = [], [], []
            for t, y, half in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "half"))):
                seen = {u for tok in set(TOKEN.findall(t.lower())) for u in _units(tok)}
                unit.extend(seen)
                toxic.extend([y] * len(seen))
                part.extend([half] * len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.string()), pa.array(toxic, pa.int32()), pa.array(part, pa.int32())], ["unit", "y", "half"])

    counted = (texts.select("text", "y", "half").mapInArrow(count, "unit string, y int, half int").groupBy("unit")
               .agg(*[F.count(F.when(F.col("half") == k, 1)).alias(f"n{k}") for k in (0, 1)],
                    *[F.coalesce(F.sum(F.when(F.col("half") == k, F.col("y"))), F.lit(0)).alias(f"t{k}") for k in (0, 1)]))
    sizes = {r.y: r.n for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    flat = ToxicityModel({}, drift, 1.0, 0.0, np.zeros(4), np.ones(4), np.zeros(15), prior)
    if len(sizes) < 2:
        return flat
    root = sizes[1] / (sizes[0] + sizes[1])
    got = counted.where(F.col("n0") + F.col("n1") >= few).toArrow()
    unit = got.column("unit").to_pylist()
    n0, n1, t0, t1 = (got.column(c).to_numpy() for c in ("n0", "n1", "t0", "t1"))

    def model_of(n, t):
        odds = _log_odds({u: (a, b) for u, a, b in zip(unit, n.tolist(), t.tolist()) if a >= few}, root, strength)
        return ToxicityModel(odds, drift, 1.0, 0.0, np.zeros(4), np.ones(4), np.zeros(15), prior)

    model = model_of(n0 + n1, t0 + t1)
    # each half is measured with the counts of the other
    crossed = [model_of(n1, t1), model_of(n0, t0)]

    def measured(k, m):
        def run(batches):
            for batch in batches:
                f = m.features(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(f), pa.list_(pa.float64()))], ["y", "f"])
        return texts.where(F.col("half") == k).select("text", "y").mapInArrow(run, "y int, f array<double>").collect()

    found = [r for k, m in enumerate(crossed) for r in measured(k, m)]
    y, x = np.array([r.y for r in found], float), np.array([r.f for r in found]).reshape(-1, 4)
    if len(set(y.tolist())) < 2:
        return flat
    # best score less log length follows a Gumbel law in clean texts: rate from
    # the spread of the positive scores, location from their mean
    plain = x[y == 0]
    best = plain[:, 0] + plain[:, 3]
    room, hit = plain[best > 0, 3], best[best > 0]
    if len(hit) > 8:
        model.rate = float(np.pi / math.sqrt(6) / max(1.0, hit.std()))
        model.offset = float(np.mean(model.rate * hit - room) - 0.5772)
    for m in crossed:
        m.rate, m.offset = model.rate, model.offset
    x = np.array([r.f for k, m in enumerate(crossed) for r in measured(k, m)]).reshape(-1, 4)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    model.weights = fit_logistic(spread(x, model.mean, model.scale), y, weight)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, at: float = 0.3) -> DataFrame:
    """Score every whole text of ``docs(doc_id, text)``.

    Labels are learnt only from rows whose crc32(doc_id as text) mod ``folds``
    is not ``held``; the score sees the text alone.  Returns doc_id, held_out,
    score (0 to 1, higher: toxic likelier) and predicted (score >= ``at``).
    Null and empty texts score like a text without tokens; a null id is not
    held out; equal texts score alike; repeated rows and extra columns are
    harmless; an empty table gives an empty result.
    """
    model = fit_toxicity(docs, labels.where(id_crc(F.col("doc_id")) % folds != held))
    return (docs.select("doc_id", F.coalesce(id_crc(F.col("doc_id")) % folds == held, F.lit(False)).alias("held_out"),
                        model.scorer()("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= F.lit(at)).cast("int")))
