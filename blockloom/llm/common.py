"""Helpers that the text operators share: shared folders, document keys, byte-level hashing.

Documents are known by ``(doc_id, doc_hash)``, ``doc_hash`` being a 64-bit hash
of id and text. Rows equal in both are one document and share every decision,
so results don't depend on the order in which Spark reads rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.sources.shared import shared_folder as shared_dir

#: Texts are hashed in pieces of this many bytes, so memory doesn't grow with a text.
PIECE = 1 << 20

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_powers: list[np.ndarray] = []


def materialise(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them (names differ in more than case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and doc_hash; other columns, whatever their names, are left out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        doc_hash().alias("doc_hash"),
    )


#: What operators keep in a worker from one task to the next, by their names: a function each that lets go of it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def rows_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20, keeps: str = "") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about most_bytes or a single row.

    A worker that served another operator before lets go of what that one remembers; keeps: the operator that may go on with it.
    """
    for owner, forget in REMEMBERED.items():
        if owner != keeps:
            forget()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * most_bytes / max(1, batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        _powers[:] = [
            np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, b, dtype=np.uint64))])
            for b in (_B, _B_INV)
        ]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans of buf, equal for equal bytes."""
    up, down = _power(len(buf) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)])])
    return mix((total[ends] - total[starts]) * down[starts] + np.uint64(seed) + (ends - starts).astype(np.uint64))


#: Beyond these planes Unicode has no letters or digits.
_PLANES = 0x40000


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter or digit, and its lower case (a single character)."""
    word, lower = np.zeros(0x110000, dtype=bool), np.arange(0x110000, dtype=np.uint32)
    word[:_PLANES] = np.fromiter((chr(i).isalnum() for i in range(_PLANES)), bool, _PLANES)
    lower[:_PLANES] = np.fromiter((ord(chr(i).lower()[0]) for i in range(_PLANES)), np.uint32, _PLANES)
    return word, lower


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def normal_codes(text: str) -> np.ndarray:
    """The code points of normal(text), made by the piece."""
    word, lower = characters()
    out, before = [], False
    for at in range(0, len(text), PIECE):
        code = codes(text[at : at + PIECE])
        own = word[code]
        keep = own.copy()
        keep[1:] |= own[:-1]
        keep[0] |= before
        before = bool(own[-1])
        out.append(np.where(own, lower[code], np.uint32(32))[keep])
    made = np.concatenate(out) if out else np.empty(0, dtype=np.uint32)
    return made[:-1] if len(made) and made[-1] == 32 else made


def normal(text: str) -> str:
    """Lower case by the character, each run of characters other than letters and digits one space."""
    return normal_codes(text).tobytes().decode("utf-32-le", "surrogatepass")


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """data cut at spaces, for hashing word by word with bounded memory."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            cut = data.find(b" ", end) if cut <= at else cut
            end = len(data) if cut < 0 else cut
        yield data[at:end]
        at = end + 1


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text that normal() has made."""
    out = []
    for data in pieces(text.encode("utf-8", "surrogatepass")):
        buf = np.frombuffer(data, dtype=np.uint8)
        gaps = np.flatnonzero(buf == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buf)]])
        out.append(span_hashes(buf, starts, ends))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """The sorted set of hashes of runs of k words; all words as one run if there are fewer."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(_B) + words[j : j + n]
    return np.unique(mix(h))


#: Classes of bytes: 0 space, 1 letter (with all bytes of other scripts), 2 digit, 3 sign.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens_of(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of a text: its lower-cased bytes, starts and ends of its tokens, and which are all capitals.

    Tokens are runs of letters, of digits or of signs.
    """
    for part in pieces(data):
        raw = np.frombuffer(part, dtype=np.uint8)
        kind = _CLASS[raw]
        edges = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(raw)]])
        starts, ends = edges[:-1], edges[1:]
        keep = kind[starts] != 0
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            continue
        upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
        capital = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 1)
        yield _LOWER[raw], starts, ends, capital


def texts(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


#: The most bits of the tables that bits_of() makes: 128 MB.
FILTER_BITS = 1 << 30


def table_size(bits: int) -> int:
    size = 1 << 16
    while size < min(bits, FILTER_BITS):
        size *= 2
    return size


def bits_of(df: DataFrame, column: str, each: int = 16) -> bytes:
    """A bit table of the values of a 64-bit hash column: a set bit for each, so none is missed.

    It has `each` bits for each value, up to FILTER_BITS (beyond 2^26 values more rows pass in vain, and none is lost).
    Spark ORs the bits together; only the table's words reach the driver, as Arrow.
    """
    size = table_size(each * df.count())
    place = F.pmod(F.col(column), F.lit(size))
    words = df.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(size // 64, dtype=np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.tobytes()


def in_bits(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit hashes may be in the table of 64-bit words."""
    place = h.astype(np.int64) & np.int64(64 * len(table) - 1)
    return (table[place >> 6].view(np.uint64) >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


#: Parts in which equal values meet: no two parts share a word of a bit table. Values that a task holds at once.
PARTS, AT_ONCE = 1 << 10, 1 << 22
BLOBS = "part int, values binary, weights binary"


def _packed(part: list[int], values: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
    blobs = (pa.array([x.tobytes() for x in column], pa.binary()) for column in (values, weights))
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *blobs], names=["part", "values", "weights"])


def _blob(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=np.int64)


def _summed(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, the sums of their weights, and which came more than once."""
    order = np.argsort(values)
    values = values[order]
    start = np.flatnonzero(np.diff(values, prepend=values[0] - 1)) if len(values) else np.empty(0, dtype=np.int64)
    sums = np.add.reduceat(weights[order], start) if len(start) else start
    return values[start], sums, np.diff(start, append=len(values)) > 1


def repeated(df: DataFrame, found: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The 64-bit values that found() gives more than once over all batches, with the sums of their weights, packed by the part.

    A task sends each of its values once, or twice if it has it more often, so that a frequent value burdens no task.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows_of(batches):
            held.append(found(batch))
            size += len(held[-1][0])
            if size >= AT_ONCE:
                yield parted(held)
                held, size = [], 0
        if size:
            yield parted(held)

    def parted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        values, weights, again = _summed(*(np.concatenate(x) for x in zip(*held)))
        values, weights = np.concatenate([values, values[again]]), np.concatenate([weights, np.zeros(again.sum(), dtype=np.int64)])
        part = (values >> 6) & (PARTS - 1)
        order = np.argsort(part, kind="stable")
        own, start = np.unique(part[order], return_index=True)
        return _packed(own.tolist(), np.split(values[order], start[1:]), np.split(weights[order], start[1:]))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(_blob(x, "values"), _blob(x, "weights")) for x in batches]
        if held:
            values, weights, again = _summed(*(np.concatenate(x) for x in zip(*held)))
            yield _packed([0], [values[again]], [weights[again]])

    tasks = min(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialise(df.mapInArrow(sent, BLOBS).repartition(tasks, "part").mapInArrow(met, BLOBS))


def bits_in(packed: DataFrame) -> bytes:
    """bits_of() the values that repeated() has packed."""
    size = table_size(2 * (packed.agg(F.sum(F.length("values"))).first()[0] or 0))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.sort(_blob(batch, "values") & np.int64(size - 1))
            start = np.flatnonzero(np.diff(place >> 6, prepend=-1))
            bits = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), start) if len(start) else np.empty(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((place[start] >> 6).astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = packed.mapInArrow(words, "word int, bits long").toArrow()
    table = np.zeros(size // 64, dtype=np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.tobytes()


def unpacked(packed: DataFrame) -> DataFrame:
    """key and size: a row for each value that repeated() has packed, and its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_blob(batch, x)) for x in ("values", "weights")], names=["key", "size"])

    return packed.mapInArrow(run, "key long, size long")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """a and root for every a of the edges (a, b), a > b: the smallest node that a is connected with.

    Each round points every node at the smallest of its parents, connects the other
    parents to that one, and goes one step further up; rounds are written to the
    shared folder. The number of rounds follows the logarithm of the longest chain.
    """
    edges = materialise(edges.where("a > b").distinct())
    while True:
        best = materialise(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("b").alias("n")))
        up = best.select(F.col("a").alias("m"), F.col("m").alias("mm"))
        if not best.where("n > 1").limit(1).count() and not best.join(up, "m", "left_semi").limit(1).count():
            return best.select("a", F.col("m").alias("root"))
        hooked = edges.join(best.where("n > 1").select("a", "m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lifted = best.join(up, "m", "left").select("a", F.coalesce("mm", "m").alias("b"))
        edges = materialise(hooked.unionByName(lifted).distinct())
