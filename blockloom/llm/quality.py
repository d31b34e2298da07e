"""Operator 7: quality scores from random-indexing word vectors and a small network.

1. Random indexing over all documents: a word (a run of letters, digits or signs,
   hashed to one of BUCKETS rows) adds up the sparse random index vectors of the
   words within two places, and its own. Tasks send partial sums of fixed size,
   which are added up by shard in a stream; the table has BUCKETS x DIMS numbers
   whatever the corpus.
2. A document is the mean of its words' vectors with the logarithm of its number
   of words. Vectors of at most SAMPLE labelled rows (those of smallest id hash,
   never of held-out folds) come to the driver.
3. A network with two layers is fitted to four fifths of them in numpy; the other
   fifth sets the temperature of its probabilities.
4. A map scores every document.

Defined results: null and empty texts have a zero vector and get the score that
the network gives it; a document's label is the largest of its valid labels;
without two classes among the labels the score is their mean (0.5 if none);
repeated rows get equal scores; columns but doc_id and text don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, span_hashes, texts, tokens_of

BUCKETS, DIMS, NONZERO, NEAR = 1 << 14, 48, 4, 2
#: The most labelled rows that a fit takes.
SAMPLE = 20_000
SHARDS = 64


def buckets_of(data: bytes) -> Iterator[np.ndarray]:
    """Row of the table for each word of a text; all-capital words and words that repeat the one before have their own."""
    for buf, starts, ends, capital in tokens_of(data):
        h = span_hashes(buf, starts, ends)
        words = ((h + capital.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
        words[1:][h[1:] == h[:-1]] = 0
        yield words


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the nonzero numbers of each index vector, from a fixed seed."""
    rng = np.random.default_rng(7)
    return np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO].astype(np.int64), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of random-indexing vectors, each of length one, from all texts."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIMS)

        def add(words: np.ndarray) -> None:
            for step in range(NEAR + 1):
                for a, b in ((words[step:], words[: len(words) - step]), (words[: len(words) - step], words[step:]))[: 1 + (step > 0)]:
                    for k in range(NONZERO):
                        total[:] += np.bincount(a * DIMS + places[b, k], weights=signs[b, k], minlength=BUCKETS * DIMS)

        held: list[np.ndarray] = []
        size = 0
        for batch in rows_of(batches):
            for text in texts(batch.column(0)):
                for words in buckets_of(text):
                    held.append(words)
                    size += len(words)
                    if size >= 1_000_000:
                        add(np.concatenate(held))
                        held, size = [], 0
        if held:
            add(np.concatenate(held))
        if total.any():
            cut = np.split(total, SHARDS)
            yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], names=["shard", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own[shard] = own.get(shard, 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x.tobytes() for x in own.values()], pa.binary())], names=["shard", "sums"])

    schema = "shard int, sums binary"
    parts = docs.select("text").mapInArrow(partial, schema).repartition(SHARDS, "shard").mapInArrow(summed, schema).collect()
    table = np.zeros(BUCKETS * DIMS)
    for shard, sums in parts:  # at most SHARDS rows, of fixed size
        table.reshape(SHARDS, -1)[shard] = np.frombuffer(bytes(sums))
    table = table.reshape(BUCKETS, DIMS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(table: np.ndarray, text: bytes) -> np.ndarray:
    """The mean vector of the text's words, and the logarithm of their number."""
    total, n = np.zeros(DIMS), 0
    for words in buckets_of(text):
        total += table[words].sum(axis=0, dtype=np.float64)
        n += len(words)
    return np.append(total / max(n, 1), np.log1p(n) / 10)


class Network:
    """Two layers; probabilities divided by a temperature that held-back rows set."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, seed: int = 1):
        self.constant = None
        if len(y) < 10 or len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        back, fit = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        moments, squares, t = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
        z = self.norm(x)
        for _ in range(rounds):
            for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                a = np.tanh(z[rows] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -30, 30))) - y[rows]) / len(rows)
                da = np.outer(d, w[2]) * (1 - a * a)
                grads = [z[rows].T @ da + 1e-4 * w[0], da.sum(axis=0), a.T @ d + 1e-4 * w[2], np.array([d.sum()])]
                t += 1
                for v, g, m, s in zip(w, grads, moments, squares):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= 0.005 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self.w, self.temperature = w, 1.0
        logits, truth = self.logits(x[back]), y[back]
        loss = lambda k: np.logaddexp(0, -np.where(truth > 0, 1, -1) * logits / k).mean()
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss) if len(back) else 1.0

    def norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.norm(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fold(of: int):
    """The crc32 of the id as text, modulo of; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def drawn(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` rows with distinct doc_id, those of smallest id hash. A bound on the hash, set from their number,
    goes first, so that all tasks together send about one and a half times that many ids."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, (1.5 * most + 100) / max(ids.count(), 1))
    return ids.where(h < int(share * (1 << 30)) + 1).orderBy(h, "doc_id").limit(most)


def sample_of(labels: DataFrame, column: str, of: int, held: int, most: int) -> DataFrame:
    """At most `most` labelled rows outside the held-out fold."""
    ids = F.col("doc_id").cast("long")
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy(ids.alias("doc_id")).agg(F.max(column).alias("label"))
    return drawn(rows.where(fold(of) != held), most)


def vectors_of(docs: DataFrame, table, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of the sampled documents; one row for each id, so at most as many as the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for batch in rows_of(batches):
            x = [pooled(own, t).astype(np.float32).tobytes() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], names=["doc_id", "x", "label"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = found.mapInArrow(run, "doc_id long, x binary, label int").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("label").alias("label")).orderBy("doc_id").collect()
    x = np.array([np.frombuffer(bytes(r.x), np.float32) for r in rows], dtype=np.float64).reshape(len(rows), DIMS + 1)
    return x, np.array([r.label for r in rows], dtype=np.float64)


def fitted(docs: DataFrame, labels: DataFrame, of: int, held: int, most: int):
    """The broadcast table of word vectors and the network."""
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(word_vectors(docs))
    sample = sample_of(labels, "quality", of, held, most).select("doc_id", F.col("label").cast("int").alias("label"))
    x, y = vectors_of(docs, table, sample)
    return table, Network(x, y)


def quality_scores(docs: DataFrame, labels: DataFrame, of: int = 4, held: int = 2, threshold: float = 0.7, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    table, network = fitted(docs, labels, of, held, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for batch in rows_of(batches):
            scores = network.scores(np.array([pooled(own, t).astype(np.float32) for t in texts(batch.column(1))], dtype=np.float64))
            ids = batch.column(0).to_pylist()
            out = [None if i is None else zlib.crc32(str(i).encode()) % of == held for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, of: int = 4, held: int = 2, threshold: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """The rows of docs whose score reaches the threshold, unchanged: one map, no shuffle.

    Only texts more likely bad than good go; of a filter, a lost clean text is the worse error.
    """
    table, network = fitted(docs, labels, of, held, most)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for batch in rows_of(batches):
            scores = network.scores(np.array([pooled(own, t).astype(np.float32) for t in texts(batch.column(at))], dtype=np.float64))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
