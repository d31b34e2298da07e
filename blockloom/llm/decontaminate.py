"""Operator 6: passages of a benchmark in documents, by the q-gram lemma.

Texts are compared in lower case with runs of other characters than letters and
digits as one space. An item counts as found if it occurs with at most
``rate`` x its length edits. The q-gram lemma then asks for n - q + 1 - q e shared
q-grams near one diagonal: an alignment with e edits stays within e diagonals of
where it begins, so hits are counted in bands of 2(e+1) diagonals that overlap by
half. Regions that reach the bound are verified by an alignment in a band.

q is chosen for each item as large as the bound allows (4 to 12); all q-grams of a text are
looked up in a bit table first, so most of a text costs a few array operations.
Items shorter than q are compared as a whole.

The benchmark is broadcast in blocks of at most BLOCK characters (a stated set of
queries against all rows); each block is one pass over the documents.

Defined results: null and empty texts and items match nothing; items with equal
normal texts are all reported; repeated documents give repeated rows; columns but
doc_id and text, item_id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, normal_codes, rows_of

#: Characters of the benchmark that one pass compares with.
BLOCK = 8_000_000
BITS = 22

FOUND = "doc_id long, item_id long, start long, end long, edits int"


def budget(n: int, rate: float) -> int:
    return int(n * rate)


def gram_size(n: int, e: int) -> int:
    """The largest q up to 12 for which the lemma asks for at least four shared q-grams; 4 at least."""
    for q in range(12, 4, -1):
        if n - q + 1 - q * e >= 4:
            return q
    return 4


def gram_hashes(code: np.ndarray, q: int) -> np.ndarray:
    n = len(code) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    # hashes of runs of 1, 2, 4 ... characters, put together by the binary digits of q
    base, part, size = 0x100000001B3, code.astype(np.uint64), 1
    out, done = None, 0
    while size <= q:
        if q & size:
            if out is None:
                out = part
            else:  # the longer run goes in front
                m = min(len(part), len(out) - size)
                out = part[:m] * np.uint64(pow(base, done, 1 << 64)) + out[size : size + m]
            done += size
        if size * 2 <= q:
            part = part[: len(part) - size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2
    return out * np.uint64(0x9E3779B97F4A7C15)


def align(item: np.ndarray, region: np.ndarray, e: int) -> tuple[int, int, int] | None:
    """Least edits of the item against a part of the region, with the part's ends; None if over e.

    Rows are items' characters, columns the region's; start and end in the region
    are free. The region is at most a few e longer than the item, so all its
    columns are the band.
    """
    m = len(region)
    cost = np.zeros(m + 1, dtype=np.int32)
    origin = np.arange(m + 1)
    place = np.arange(m + 1, dtype=np.int32)
    for i, c in enumerate(item, 1):
        diagonal = cost[:-1] + (region != c)
        up = cost + 1
        new, start = up.copy(), origin.copy()
        better = diagonal <= up[1:]
        new[1:][better] = diagonal[better]
        start[1:][better] = origin[:-1][better]
        # moves to the right: least over the columns before, by one running minimum
        flat = new - place
        run = np.minimum.accumulate(flat)
        take = flat > run
        source = np.maximum.accumulate(np.where(take, 0, np.arange(m + 1)))
        cost, origin = run + place, start[source]
        if cost.min() > e:
            return None
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def exact(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int] | None:
    """What align() gives for the first place where the region holds the item unchanged; None if it doesn't."""
    own, text, at = item.tobytes(), region.tobytes(), -1
    while (at := text.find(own, at + 1)) >= 0:
        if at % 4 == 0:
            return 0, at // 4, at // 4 + len(item)
    return None


class Items:
    """The q-grams of a block of items, by q."""

    def __init__(self, rows: list[tuple[int, str]], rate: float):
        self.items = [(i, code) for i, code in ((i, normal_codes(t or "")) for i, t in rows) if len(code)]
        self.by_q: dict[int, tuple] = {}
        self.edits = np.array([budget(len(code), rate) for _, code in self.items], dtype=np.int64)
        groups: dict[int, list[int]] = {}
        sizes = [min(gram_size(len(code), budget(len(code), rate)), len(code)) for _, code in self.items]
        common = min([q for q in sizes if q >= 10], default=10)  # the bound holds for smaller q too, and one q is one pass
        for k, q in enumerate(sizes):
            groups.setdefault(min(q, common), []).append(k)
        for q, members in groups.items():
            h = [gram_hashes(self.items[k][1], q) for k in members]
            keys, owner = np.concatenate(h), np.repeat(members, [len(x) for x in h])
            at = np.concatenate([np.arange(len(x)) for x in h])
            order = np.argsort(keys, kind="stable")
            table = np.zeros(1 << BITS, dtype=bool)
            table[keys >> np.uint64(64 - BITS)] = True
            self.by_q[q] = keys[order], owner[order], at[order], table

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text: item_id, start, end (in the normal text) and edits of the best place of each item found.

        The texts are looked up as one, with a sign between them that no item has.
        """
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        code = [normal_codes(x) for x in texts]
        first = np.cumsum([0, *(len(x) + 1 for x in code)])
        joined = np.zeros(first[-1], dtype=np.uint32)
        for x, at in zip(code, first):
            joined[at : at + len(x)] = x
        for q, (keys, owner, at, table) in self.by_q.items():
            h = gram_hashes(joined, q)
            hit = np.flatnonzero(table[h >> np.uint64(64 - BITS)])
            low = np.searchsorted(keys, h[hit], "left")
            same = keys[np.minimum(low, len(keys) - 1)] == h[hit]
            hit, low = hit[same], low[same]
            if not len(hit):
                continue
            count = np.searchsorted(keys, h[hit], "right") - low
            # a hit in a text for each posting of its q-gram
            place = np.repeat(hit, count)
            post = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            item, text = owner[post], np.searchsorted(first, place, "right") - 1
            self.bands(q, text, item, place - first[text] - at[post], code, best)
        return [[(self.items[k][0], s, t, e) for k, (e, s, t) in sorted(x.items())] for x in best]

    def bands(self, q: int, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray, code: list[np.ndarray], best: list[dict]) -> None:
        """Counts the hits of each text and item in half bands, and verifies the bands of two that reach the bound."""
        width = self.edits + 1
        half = diagonal // width[item]
        least = half.min()
        span = int(half.max() - least) + 3
        band, number = np.unique((text * len(self.items) + item) * span + half - least, return_counts=True)
        both = number.copy()
        both[:-1] += np.where(band[1:] == band[:-1] + 1, number[1:], 0)
        k = band // span % len(self.items)
        n = np.array([len(x) for _, x in self.items], dtype=np.int64)[k]
        need = np.maximum(1, n - q + 1 - q * self.edits[k])
        for b in band[both >= need].tolist():
            pair, b = divmod(b, span)
            text_at, own = divmod(pair, len(self.items))
            self.verify(own, (b + int(least)) * int(width[own]), code[text_at], best[text_at])

    def verify(self, k: int, diagonal: int, code: np.ndarray, best: dict) -> None:
        """An alignment that starts in the band from this diagonal lies within it and e more on either side."""
        if k in best and best[k][0] == 0:
            return
        item, e = self.items[k][1], int(self.edits[k])
        low, high = max(0, diagonal - e), min(len(code), diagonal + 2 * (e + 1) + len(item) + e)
        found = exact(item, code[low:high]) or align(item, code[low:high], e)
        if found and (k not in best or found[0] < best[k][0]):
            best[k] = found[0], low + found[1], low + found[2]


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in blocks of bounded size, one at a time on the driver."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK:
            yield held
            held, size = [], 0
    yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """doc_id, item_id, start, end and edits for each item found in each document."""
    sc = docs.sparkSession.sparkContext

    def one(rows: list[tuple[int, str]]) -> DataFrame:
        shared = sc.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Items(shared.value, rate)
            for batch in rows_of(batches, PIECE):
                out = [(d, *x) for d, found in zip(batch.column(0).to_pylist(), own.find([t or "" for t in batch.column(1).to_pylist()])) for x in found]
                columns = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "start", "end", "edits"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)

    return reduce(DataFrame.unionAll, map(one, blocks_of(benchmark)))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """The rows of docs in which no item occurs, unchanged: a map for each block of the benchmark, no shuffle."""
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index("text")
    for rows in blocks_of(benchmark):
        shared = sc.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Items(shared.value, rate)
            for batch in rows_of(batches, PIECE):
                yield batch.filter(pa.array([not x for x in own.find([t or "" for t in batch.column(at).to_pylist()])], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
