"""Document fingerprints: I-Match over randomised lexicon subsets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_words, mix, packed, stored, unpacked

#: hex digits of one signature in the fingerprint string
DIGITS = 3
#: rates 1/2, 1/4, ... at which subsets of the lexicon are drawn, and subsets a rate
RATES, SUBSETS = 11, 10


def _terms(text: str) -> np.ndarray:
    """Hashes of the distinct lower-case terms of a text."""
    return hash_words(list({w.encode("utf-8", "surrogatepass") for w in text.lower().split()}))


def lexicon(docs: DataFrame, low: float, high: float) -> np.ndarray:
    """Hashes of the terms whose document share lies in [low, high], sorted.

    The band is one of inverse document frequency, log(1 / share), and does
    not move with the corpus.  Counted over all documents, combined per batch
    before the shuffle.  At most (mean distinct terms of a document) / low
    terms can reach the share ``low``, whatever the corpus, so the result has
    a fixed bound.
    """
    def count(batches):
        for batch in batches:
            found = [_terms(t) for t in batch.column("text").to_pylist() if t]
            if found:
                term, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int32))], ["term", "n"])

    rows = docs.count()
    counted = docs.select("text").mapInArrow(count, "term long, n int").groupBy("term").agg(F.sum("n").alias("n"))
    band = counted.where((F.col("n") >= low * rows) & (F.col("n") <= high * rows)).select("term").toArrow()
    return np.sort(band.column("term").to_numpy().view(np.uint64))


def _sequence(terms: np.ndarray, owner: np.ndarray, key: int, out: np.ndarray) -> None:
    """Hash the terms of each owner, which come sorted, as one sequence into
    ``out[owner]``; owners without terms keep their 0."""
    if not len(terms):
        return
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    place = np.arange(len(terms)) - np.repeat(starts, np.diff(np.append(starts, len(terms))))
    with np.errstate(over="ignore"):
        total = np.add.reduceat(mix(terms + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), starts)
    bits = np.uint64((1 << 4 * DIGITS) - 1)
    out[owner[starts]] = np.maximum(mix(total ^ np.uint64(key)) & bits, np.uint64(1))


def signatures(texts: list[str], lex: np.ndarray, rates: int = RATES, subsets: int = SUBSETS) -> np.ndarray:
    """I-Match: one row per text of 1 + ``rates`` * ``subsets`` signatures.

    The first is the hash of all its distinct terms in the lexicon, sorted;
    each other one that of those in a random subset of the lexicon.  Subsets
    are the same for all texts: subset j at rate r keeps the terms whose hash
    with key j starts with r zero bits, a 2^r-th of the lexicon, so that texts
    of any length have subsets that hold a few of their terms.  A text without
    a term in the lexicon uses all its terms; 0 stands for no term."""
    kept, owner = [], []
    for i, t in enumerate(texts):
        terms = np.unique(_terms(t))
        at = np.searchsorted(lex, terms)
        known = terms[(at < len(lex)) & (lex[np.minimum(at, len(lex) - 1)] == terms)] if len(lex) else terms[:0]
        kept.append(known if len(known) else terms)
        owner.append(np.full(len(kept[-1]), i))
    out = np.zeros((len(texts), 1 + rates * subsets), np.uint64)
    if not texts:
        return out
    flat, owner = np.concatenate(kept), np.concatenate(owner)
    _sequence(flat, owner, 0, out[:, 0])
    for j in range(subsets):
        v = mix(flat ^ mix(np.array([j + 1], np.uint64) * np.uint64(0x632BE59BD9B4E019)))
        terms, whose = flat, owner
        for r in range(1, rates + 1):
            member = v < np.uint64(1 << (64 - r))
            v, terms, whose = v[member], terms[member], whose[member]
            _sequence(terms, whose, r * subsets + j, out[:, 1 + (r - 1) * subsets + j])
    return out


def likeness(a: np.ndarray, b: np.ndarray, subsets: int = SUBSETS) -> np.ndarray:
    """Of two rows of signatures: 1 if all terms are equal (or both have none);
    else, of the rates at which at least half of the subsets hold a term of
    either, the greatest share of equal signatures."""
    some = ((a != 0) | (b != 0))[:, 1:].reshape(len(a), -1, subsets).sum(axis=2)
    same = ((a == b) & (a != 0))[:, 1:].reshape(len(a), -1, subsets).sum(axis=2)
    share = np.where(2 * some >= subsets, same / np.maximum(some, 1), 0.0)
    return np.where(a[:, 0] == b[:, 0], 1.0, share.max(axis=1, initial=0.0))


def _text(sig: np.ndarray) -> str:
    return "".join(f"{int(x):0{DIGITS}x}" for x in sig)


def _edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first of the next."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def _rows(ids: list, texts: list[str], sigs: np.ndarray, nexts: list[str], next_sigs: np.ndarray, lex: np.ndarray) -> dict[str, list]:
    """Result columns of texts whose following texts are known."""
    edited = [_edit(a, b) for a, b in zip(texts, nexts)]
    esigs = signatures(edited, lex)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": [_text(s) for s in sigs], "edited_fingerprint": [_text(s) for s in esigs],
        "near_edited": likeness(sigs, esigs).tolist(), "near_next": likeness(sigs, next_sigs).tolist()}


def fingerprint_documents(docs: DataFrame, low: float = 2e-4, high: float = 0.05) -> DataFrame:
    """I-Match fingerprints of ``docs(doc_id, text)`` and of the edited texts.

    The edited text has the last floor(n_chars / 4) code points replaced by
    the first as many (or all) of the next document in ascending doc_id (after
    the last: the first).  Texts are sorted over range partitions; within one
    the next document streams by, and the last row of a partition meets the
    first of the following one in a second step over two rows a partition.

    Returns one row per input row: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint (all signatures of `signatures`), near_edited
    and near_next (`likeness`: with the edited text, with the next document).  A
    null text counts as empty; empty texts sign zeros and are like each other; null ids
    come first and equal ids are ordered by a hash of the text; a single
    document is its own next; an empty table gives an empty result.  Extra
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    lex = lexicon(docs, low, high)
    order = ["doc_id", "h"]
    sorted_docs = (docs.select("doc_id", F.xxhash64("text").alias("h"), packed("text").alias("z"))
                   .repartitionByRange(*order).sortWithinPartitions(*order))
    names = [c.split()[0] for c in RESULT.split(", ")]
    wide = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                      ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                      ("kind", pa.string()), ("part", pa.int32()), ("z", pa.binary())])

    def walk(batches):
        part = TaskContext.get().partitionId()
        held = None  # last row so far: id, text, signatures, packed
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                z = batch.column("z")
                texts = [b.decode("utf-8", "surrogatepass") for b in unpacked(z)]
                ids, z = batch.column("doc_id").to_pylist(), z.to_pylist()
                sigs = signatures(texts, lex)
                if held is None:
                    yield pa.RecordBatch.from_pylist([{"doc_id": ids[0], "kind": "head", "part": part, "z": z[0]}], wide)
                else:
                    ids, texts, z = [held[0], *ids], [held[1], *texts], [held[3], *z]
                    sigs = np.vstack([held[2][None], sigs])
                held = ids[-1], texts[-1], sigs[-1], z[-1]
                if len(ids) > 1:
                    cols = _rows(ids[:-1], texts[:-1], sigs[:-1], texts[1:], sigs[1:], lex)
                    n = len(ids) - 1
                    yield pa.RecordBatch.from_pydict(cols | {"kind": ["done"] * n, "part": [part] * n, "z": [None] * n}, wide)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "kind": "tail", "part": part, "z": held[3]}], wide)

    walked = stored(sorted_docs.mapInArrow(walk, RESULT + ", kind string, part int, z binary"), "walked")
    heads = walked.where("kind = 'head'").select(F.col("part").alias("to"), F.col("z").alias("next_z"))
    by = Window.orderBy("to")
    turns = heads.select("to").select(F.col("to").alias("part"), F.coalesce(F.lead("to").over(by), F.min("to").over(Window.partitionBy())).alias("to"))
    ends = walked.where("kind = 'tail'").select("part", "doc_id", "z").join(turns, "part").join(heads, "to").select("doc_id", "z", "next_z")

    def close(batches):
        for batch in batches:
            a, b = ([x.decode("utf-8", "surrogatepass") for x in unpacked(batch.column(c))] for c in ("z", "next_z"))
            yield pa.RecordBatch.from_pydict(_rows(batch.column("doc_id").to_pylist(), a, signatures(a, lex), b, signatures(b, lex), lex),
                                             pa.schema([wide.field(n) for n in names]))

    return walked.where("kind = 'done'").select(*names).unionByName(ends.mapInArrow(close, RESULT))
