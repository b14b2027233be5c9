"""Quality classifier: naive Bayes support vector machine.

Features are indicators of n-grams (one to three words), of the words and of
their shapes. Words are lower-cased runs of ASCII letters, digits and non-ASCII
bytes. A shape keeps a word's punctuation and the kinds of its bytes, and says
whether the word repeats the one before. Shapes carry over to words not seen in
training; words tell what has an ordinary shape (spam vocabulary, boilerplate).
Both are hashed to the same ``BUCKETS`` buckets, so the model has a fixed size
whatever the corpus.

1. Labels are joined to ids first. Texts of labelled training rows, kept apart by
   a fixed-size sketch of their ids, meet their label where they are scanned if the
   labels are few, else in one shuffle; there each task featurises them, adds up its own two count vectors and
   hands on features of the sample alone. No feature is shuffled.
2. Class counts of every bucket over all training rows give the log-count ratios
   ``r``: log((p / |p|) / (q / |q|)), smoothed by one.
3. A linear hinge-loss model over the indicators scaled by ``r`` is fitted by
   dual coordinate descent, in one task, on at most ``max_rows`` training rows
   and ``MAX_VALUES`` features of theirs, those of the smallest hash of id and
   text (chosen before any feature exists; repeated rows once). These bounds are
   the only sample here. The weights are pulled towards their mean size by
   ``1 - beta``.
4. Every whole text is scored in its scan: a look-up per distinct n-gram.

Rows whose crc32(doc_id as text) mod 3 is 1 are held out and never learnt from.
Inputs of a score are the text alone.

Defined results: null and empty texts have no features and get the score of the
bias. A null id is never held out nor labelled. Several labels of one id count
as their majority (ties as 1); repeated documents count each. Without training
rows every score is 0.5; null labels are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import hashing
from quarry.llm.common import few, in_small_batches, staged
from quarry.plans.sketch import key_sketch, maybe_in

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
MAX_ROWS = 20_000  # training rows of the fit; the counts take all rows
MAX_VALUES = 1 << 25  # features of these rows together (128 MiB)
HASHES = 1 << 62
LONG_TEXT = 1 << 18  # words whose n-grams are held at once


WHITE, LOWER, UPPER, DIGIT, OTHER = range(5)


def _kinds() -> np.ndarray:
    """Byte -> kind: white space, lower case, upper case, digit, part of another script, else itself."""
    kind = np.arange(256, dtype=np.uint8)
    for k, (a, b) in ((WHITE, (0x09, 0x0D)), (WHITE, (0x20, 0x20)), (LOWER, (0x61, 0x7A)), (UPPER, (0x41, 0x5A)),
                      (DIGIT, (0x30, 0x39)), (OTHER, (0x80, 0xFF))):
        kind[a:b + 1] = k
    kind[1:5] = 5  # control characters
    return kind


KIND = _kinds()
BETWEEN = KIND == WHITE
# by kind: letters, kinds whose runs become one, and signs
LETTERS = np.isin(np.arange(256), (LOWER, UPPER, OTHER))
RUNS = np.isin(np.arange(256), (LOWER, UPPER, DIGIT, OTHER))
SIGNS = np.arange(256) > OTHER
IS_KIND = np.arange(256) == WHITE
BETWEEN_WORDS = ~hashing.byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
REPEATED = np.uint64(0x27D4EB2F165667C5)


def shapes(data: bytes) -> bytes:
    """Kinds of the bytes of a text; a run of one kind becomes one, a run of another sign one or two.

    Bytes of other scripts count as letters of the kind before them.
    """
    kind = KIND[np.frombuffer(data, np.uint8)]
    keep = kind == OTHER  # in place: a long text takes a few bytes a byte
    keep[1:] &= LETTERS[kind[:-1]]
    keep[:1] = False
    kind = kind[np.logical_not(keep, out=keep)]
    del keep
    same = kind[1:] == kind[:-1]
    thrice = SIGNS[kind[2:]]
    thrice &= same[1:]
    thrice &= same[:-1]
    same &= RUNS[kind[1:]]
    same[1:] |= thrice
    del thrice
    keep = np.ones(len(kind), bool)
    np.logical_not(same, out=keep[1:])
    return kind[keep].tobytes()


def ngrams(h: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of one to three of some hashed words."""
    a, b, c = (h * k for k in ODD)
    two = (a[:-1] ^ (b[1:] >> np.uint64(7))) * ODD[1]
    three = ((a[:-2] ^ (b[1:-1] >> np.uint64(7))) * ODD[1] ^ (c[2:] >> np.uint64(11))) * ODD[2]
    return np.concatenate([a, two, three])


def features_of(texts, use_shapes: bool = True, use_words: bool = True) -> Iterator[np.ndarray]:
    """The distinct buckets of each text's n-grams, sorted."""
    shift = np.uint64(64 - BUCKET_BITS)
    for _, group in hashing.blocks(texts, hashing.SMALL):
        exact, counts = hashing.words_of(group, BETWEEN)
        one, _ = hashing.words_of([shapes(g) for g in group], IS_KIND)
        plain, plain_counts = hashing.words_of(group, BETWEEN_WORDS, hashing.LOWER)
        start = plain_start = 0
        for n, m in zip(counts.tolist(), plain_counts.tolist()):
            w, h = exact[start:start + n], one[start:start + n].copy()
            start += n
            h[1:][w[1:] == w[:-1]] ^= REPEATED
            own = plain[plain_start:plain_start + m]
            plain_start += m
            used = [x for x, use in ((h, use_shapes), (own, use_words)) if use]
            if n + m <= LONG_TEXT:
                yield np.unique((np.concatenate([ngrams(x) for x in used]) >> shift).astype(np.int32))
                continue
            seen = np.zeros(BUCKETS, bool)  # a long text in pieces that overlap by two words
            for x in used:
                for at in range(0, len(x), LONG_TEXT):
                    seen[(ngrams(x[at:at + LONG_TEXT + 2]) >> shift).astype(np.int32)] = True
            yield np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # by bucket, log-count ratio included
    bias: float

    def score(self, features: np.ndarray) -> float:
        m = self.bias + float(self.weights[features].sum())
        return float(1 / (1 + np.exp(-m))) if m > -700 else 0.0


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, label of every labelled id that is not held out."""
    id_type = docs.schema["doc_id"].dataType  # hashes of ids must be of one type
    return (labels.withColumn("doc_id", F.col("doc_id").cast(id_type)).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
            .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label")))


CHUNK = 1 << 14  # buckets whose counts travel together
GATHERED = "chunk int, counts binary, label int, hash long, n int, features binary"


def _gather(least_hash: int):
    """Count vectors of a task's training rows, and the features of those whose hash is below ``least_hash``."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen = np.zeros((2, BUCKETS), np.int64), set()
        for b in batches:
            kept = []
            for label, h, f in zip(b.label.tolist(), b.hash.tolist(), features_of(b.text)):
                counts[0 if label else 1, f] += 1
                if h < least_hash and h not in seen:
                    seen.add(h)
                    kept.append((label, h, len(f), f.tobytes()))
            if kept:
                yield pd.DataFrame(kept, columns=["label", "hash", "n", "features"]).assign(chunk=-1, counts=None)[GATHERED_NAMES]
        for at in range(0, BUCKETS, CHUNK):
            if (own := counts[:, at:at + CHUNK]).any():
                yield pd.DataFrame({"chunk": [at // CHUNK], "counts": [zlib.compress(own.tobytes(), 1)], "label": 0, "hash": 0, "n": 0, "features": None})

    return gather


GATHERED_NAMES = [x.split()[0] for x in GATHERED.split(", ")]


def gathered(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """Counts of each task (chunk, counts) and, with chunk -1, the sample (label, hash, n, features), stored."""
    lab = staged(training_labels(docs, labels, label), "quality-labels")
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(HASHES))
    rows = docs.select("doc_id").join(lab.select("doc_id"), "doc_id").count()
    part = min(1.0, 1.2 * (max_rows + 1000) / max(1, rows))  # the few too many are cut later
    near = maybe_in(docs.select("doc_id", "text"), key_sketch(lab, "doc_id"), "doc_id").join(few(lab), "doc_id")
    return staged(in_small_batches(near).select("label", hashed.alias("hash"), "text").mapInPandas(_gather(int(part * HASHES)), GATHERED), "quality-gathered")


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 0.01,
                            epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights (over scaled indicators) and bias of the L1-loss linear SVM."""
    w, bias, rng = np.zeros(len(scale)), 0.0, np.random.default_rng(seed)
    alpha = np.zeros(len(rows))
    square = scale * scale
    diagonal = np.array([square[r].sum() + 1.0 for r in rows])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v, label = rows[i], scale[rows[i]], y[i]  # looked up each time: only the rows' buckets are held
            gradient = label * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost)
            step = (new - alpha[i]) * label
            if step:
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4 * cost:
            break
    return w, bias


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sum of each chunk's counts, read as a stream."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, counts in zip(b.chunk.tolist(), b["counts"]):
            own = np.frombuffer(zlib.decompress(counts), np.int64)
            sums[chunk] = sums[chunk] + own if chunk in sums else own
    yield pd.DataFrame({"chunk": list(sums), "counts": [x.tobytes() for x in sums.values()]})


def log_count_ratios(rows: DataFrame) -> np.ndarray:
    """``r`` of every bucket, from (chunk, counts) of all tasks; buckets that never occur have 0."""
    got = rows.repartition(BUCKETS // CHUNK, "chunk").mapInPandas(_summed, "chunk int, counts binary").toArrow().to_pydict()  # 2 * BUCKETS numbers
    counts = np.zeros((2, BUCKETS), np.int64)
    for chunk, own in zip(got["chunk"], got["counts"]):
        counts[:, chunk * CHUNK:(chunk + 1) * CHUNK] = np.frombuffer(own, np.int64).reshape(2, CHUNK)
    p, q = counts + 1.0
    return np.where(counts.any(axis=0), np.log((p / p.sum()) / (q / q.sum())), 0.0)


def _fitter(ratio):
    """Fits the rows of the sample, in order of their hash; one row: weights over scaled indicators, and the bias."""

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = ratio.value
        by_hash = {h: (label, f) for b in batches for h, label, f in zip(b.hash.tolist(), b.label.tolist(), b.features)}
        rows = [by_hash[h] for h in sorted(by_hash)]
        y = np.array([1.0 if label else -1.0 for label, _ in rows])
        w, bias = dual_coordinate_descent([np.frombuffer(f, np.int32) for _, f in rows], y, r)
        yield pd.DataFrame({"weights": [w.tobytes()], "bias": [bias]})

    return fitted


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, beta: float = 0.75,
        max_values: int = MAX_VALUES) -> Model:
    rows = gathered(docs, labels, label, max_rows)
    ratio = log_count_ratios(rows.where("chunk >= 0").select("chunk", "counts"))
    sample = rows.where("chunk < 0").select("label", "hash", "n", "features")
    # the last hash within both bounds, from a little over max_rows narrow rows
    sizes = sample.groupBy("hash").agg(F.max("n").alias("n")).toArrow().to_pandas().sort_values("hash")
    within = sizes[(np.arange(len(sizes)) < max_rows) & (sizes.n.cumsum() <= max_values)]
    if not len(within):
        return Model(np.zeros(BUCKETS), 0.0)
    sample = sample.where(F.col("hash") <= int(within.hash.iloc[-1]))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    got = sample.coalesce(1).mapInPandas(_fitter(shared), "weights binary, bias double").first()
    w, bias = np.frombuffer(got["weights"]), got["bias"]
    mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
    return Model(((1 - beta) * mean + beta * w) * ratio, bias)


def score_column(spark, model: Model, text: str = "text"):
    """The score of a text column; the model (2 MiB) is broadcast."""
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*shared.value)
        for batch in texts:
            yield pd.Series(list(map(m.score, features_of(batch))), dtype="float64")

    return score(text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted and applied to every document."""
    model = fit(docs, labels)
    out = in_small_batches(docs).select("doc_id", held_out().alias("held_out"), score_column(docs.sparkSession, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """The documents predicted as good, with all their columns."""
    model = fit(docs if train_docs is None else train_docs, labels)
    cols = docs.columns
    return in_small_batches(docs).withColumn("__score", score_column(docs.sparkSession, model)).where("__score >= 0.5").select(*cols)
