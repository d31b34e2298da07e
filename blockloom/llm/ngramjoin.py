"""Operator 3: all documents alike by the Jaccard similarity of their runs of five words.

1. Each text becomes its set of hashed shingles, a 128-bit hash of that set and
   HASHES MinHash values. Texts with equal sets are one class; only one of each
   goes on.
2. Candidates share one of BANDS bands of values: a pair at the threshold of 0.8
   is missed with probability (1 - 0.8^5)^32 < 4e-6. Buckets with the same members are
   compared once, and a pair only in the first band that it shares.
3. Within buckets, pairs are compared by their MinHash values STEP at a time, and
   dropped once the posterior probability (uniform prior) that their similarity
   reaches the threshold is below TOLERANCE. Large buckets are cut into blocks, and
   each pair of blocks is a unit of bounded size, so no task holds a bucket and no
   pairs are emitted: a unit returns which of its texts have a partner left.
4. Those texts' shingles are read (a second scan through a bit table of fixed size)
   and the pairs left are verified exactly, unit by unit; a unit returns a spanning
   forest of its links and each text's number of links.
5. Connected classes form a group.

Defined results: class_id is the smallest doc_id of a group, copy_of that of the
texts with an equal set; n_links counts the other texts (each text once, however
often it is copied) with similarity of 0.8 or more. A text with fewer than five words has
one shingle, all its words; texts without words are alike only if equal. Null texts
are empty texts; a null doc_id is larger than all others; rows with equal doc_id and
text get equal rows; an empty table gives no rows; columns but doc_id and text don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_of, components, fresh, groups, in_bits, materialise, mix, normal, rows_of, shingles, with_keys, word_hashes

RUN, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, STEP = 32, 5, 32
HASHES = BANDS * ROWS
#: Texts of a block; a unit holds two blocks at most.
BLOCK = 2048
LAST = (1 << 63) - 1

_SETS = "doc_id long, doc_hash long, text_hash long, c binary, n int, sig binary"


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(items: np.ndarray, ab: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes: the upper half of a x + b."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(items), 512):
        np.minimum(least, (ab[0][:, None] * items[None, at : at + 512] + ab[1][:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def set_hash(items: np.ndarray) -> bytes:
    return np.array([items.sum(), mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], dtype=np.uint64).byteswap().tobytes()


def least_matches() -> dict[int, int]:
    """For 32, 64 ... values compared: how many must agree for a pair to stay."""
    x = np.linspace(0, 1, 20001)[1:-1]
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log(1 - x)
            p = np.exp(log - log.max())
            if p[x >= THRESHOLD].sum() / p.sum() >= TOLERANCE:
                out[n] = m
                break
    return out


def sets_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ab = coefficients()
        for batch in rows_of(batches):
            out: list[list] = [[], [], []]
            for text, own in zip(batch.column("text").to_pylist(), batch.column("text_hash").to_pylist()):
                items = shingles(word_hashes(normal(text)), RUN)
                out[0].append(set_hash(items) if len(items) else b"\0" * 8 + int(own).to_bytes(8, "big", signed=True))
                out[1].append(len(items))
                out[2].append(signature(items, ab).tobytes() if len(items) else b"")
            columns = [batch.column(x) for x in ("doc_id", "doc_hash", "text_hash")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=[x.split()[0] for x in _SETS.split(", ")])

    return with_keys(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, _SETS)


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.zeros(s.shape[:2], dtype=np.uint64)
    for j in range(ROWS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j] + np.uint64(1)
    return mix(h)


class Unit:
    """The pairs of one unit: of one block, or of two blocks across."""

    def __init__(self, table: pa.Table, need: dict[int, int]):
        self.need = need
        self.band = table.column("band")[0].as_py()
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
        self.keys = bands(self.sig)
        side = table.column("blk").to_numpy()
        across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        order = np.arange(len(side))
        self.partners_of = (lambda r: order[side > side[r]]) if across else (lambda r: order[r + 1 :])
        self.rows = np.flatnonzero(side == table.column("i")[0].as_py()) if across else order

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each row with those of its partners that the posterior leaves."""
        for r in self.rows:
            at = self.partners_of(r)
            same = self.keys[at] == self.keys[r]
            at = at[same[:, self.band] & ~same[:, : self.band].any(axis=1)]
            hits = np.zeros(len(at), dtype=np.int64)
            for n, least in self.need.items():
                if not len(at):
                    break
                hits += (self.sig[at, n - STEP : n] == self.sig[r, n - STEP : n]).sum(axis=1)
                stay = hits >= least
                at, hits = at[stay], hits[stay]
            if len(at):
                yield int(r), at


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    need = least_matches()
    for table in groups(batches, 3):
        unit = Unit(table, need)
        left = np.zeros(table.num_rows, dtype=bool)
        for r, at in unit.pairs():
            left[r] = True
            left[at] = True
        if left.any():
            for batch in table.select(["key", "i", "j", "blk", "band", "c"]).filter(pa.array(left)).combine_chunks().to_batches():
                yield batch


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    need = least_matches()
    for table in groups(batches, 3):
        unit = Unit(table, need)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("items").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        names, w = table.column("c").to_pylist(), table.column("w").to_numpy()
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        mark = np.zeros(len(vocabulary), dtype=np.int64)
        root, count = list(range(len(sets))), np.zeros(len(sets), dtype=np.int64)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for r, at in unit.pairs():
            own = flat[ends[r] - sizes[r] : ends[r]]
            mark[own] = 1
            places = np.concatenate([np.arange(ends[a] - sizes[a], ends[a]) for a in at])
            starts = np.concatenate([[0], np.cumsum(sizes[at])[:-1]])
            both = np.add.reduceat(mark[flat[places]], starts)
            mark[own] = 0
            # 0.8 as a fraction, so that pairs exactly at the threshold count
            ok = at[5 * both >= 4 * (sizes[at] + sizes[r] - both)]
            count[ok] += w[r]
            count[r] += w[ok].sum()
            for a in ok.tolist():
                x, y = find(r), find(a)
                if x != y:
                    x, y = (x, y) if names[x] < names[y] else (y, x)
                    root[y] = x
        parents = [names[find(i)] for i in range(len(sets))]
        kept = [i for i in range(len(sets)) if count[i]]
        if kept:
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in kept], pa.binary()), pa.array([parents[i] for i in kept], pa.binary()), pa.array([int(count[i]) for i in kept], pa.int64())],
                names=["a", "b", "n_links"],
            )


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copy_of, n_links and doc_hash of each row."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = materialise(sets_of(docs))
    id_ = F.coalesce("doc_id", F.lit(LAST))
    per_text = every.groupBy("c", "text_hash").agg(F.min(F.struct(id_.alias("id"), "doc_hash", "n", "sig")).alias("x"))
    reps = materialise(
        per_text.groupBy("c").agg(F.min("x").alias("x"), F.count("*").alias("w")).select("c", "w", "x.id", "x.doc_hash", "x.n", "x.sig")
    )
    key = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sig, b * {4 * ROWS} + 1, {4 * ROWS})))")
    rows = reps.where("n > 0").select("c", F.posexplode(key).alias("band", "key"))
    buckets = (
        rows.groupBy("key").agg(F.min("band").alias("band"), F.count("*").alias("m"), F.sum(F.xxhash64("c").cast("decimal(20,0)")).alias("members"))
        .where("m > 1")
        .groupBy("m", "members").agg(F.min(F.struct("band", "key")).alias("x"))
        .select("m", "x.band", "x.key")
    )
    buckets = materialise(buckets)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    units = (
        rows.select("c", "key").join(buckets, "key")
        .withColumn("blk", F.pmod(F.xxhash64("c", F.lit(1)), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "band", "c")
    )
    sigs = reps.select("c", "sig", "w")
    dealt = units.join(sigs, "c").select("key", "i", "j", "blk", "band", "c", "sig").repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    left = materialise(dealt.mapInArrow(candidates, "key long, i int, j int, blk int, band int, c binary"))

    alive = materialise(left.select("c").distinct().join(reps.select("c", "doc_hash"), "c"))
    table = spark.sparkContext.broadcast(bits_of(alive, "doc_hash"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, dtype=np.int64)
        for batch in rows_of(batches):
            hit = np.flatnonzero(in_bits(bits, batch.column("doc_hash").to_numpy()))
            own = batch.take(pa.array(hit))
            items = [shingles(word_hashes(normal(t)), RUN) for t in own.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_hash"), pa.array([set_hash(x) for x in items], pa.binary()), pa.array([x.tobytes() for x in items], pa.binary())], names=["doc_hash", "c", "items"]
            )

    # joined by c alone, all sides meet in one exchange: the sets, the widest rows here, are dealt once before they go to the units
    own = alive.select("c", F.col("doc_hash").alias("own"))
    found = with_keys(docs).mapInArrow(again, "doc_hash long, c binary, items binary").join(own, "c").where("doc_hash = own").dropDuplicates(["c"]).select("c", "items")
    full = left.join(found, "c").join(sigs, "c").select("key", "i", "j", "blk", "band", "c", "sig", "w", "items").repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    linked = materialise(full.mapInArrow(links, "a binary, b binary, n_links long"))

    roots = components(linked.select("a", "b"))
    counts = linked.groupBy(F.col("a").alias("c")).agg(F.sum("n_links").alias("n_links"))
    class_ = reps.select("c", "id", "w").join(roots.select(F.col("a").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    class_ = materialise(class_.join(counts, "c", "left"))
    smallest = materialise(class_.groupBy("root").agg(F.min("id").alias("smallest")))
    ready = materialise(class_.join(smallest, "root").select("c", "id", "smallest", (F.coalesce("n_links", F.lit(0)) + F.col("w") - 1).alias("n_links")))
    known = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return every.select("doc_id", "doc_hash", "c").join(ready, "c").select(
        "doc_id", known("smallest").alias("class_id"), known("id").alias("copy_of"), "n_links", "doc_hash"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of which no other in their group has a smaller id (of equal ids: a smaller hash); repeated rows once.

    Other columns stay as they are, whatever their names.
    """
    own, keep_id, keep_hash = fresh(docs, "own_hash", "keep_id", "keep_hash")
    found = classes(docs)
    keep = found.where(F.col("class_id").eqNullSafe(F.col("doc_id"))).groupBy("class_id").agg(F.min("doc_hash").alias(keep_hash))
    keep = keep.select(keep_hash, F.col("class_id").alias(keep_id))
    keyed = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    kept = keyed.join(keep, (F.col(own) == F.col(keep_hash)) & F.col("doc_id").eqNullSafe(F.col(keep_id)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).select(*docs.columns)
