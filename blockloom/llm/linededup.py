"""Operator 5: lines that repeat across documents, exactly or within a few words.

Lines are compared as sequences of words (lower case, without signs). Every line with a
letter or digit counts, and of equal lines the earliest (by doc_id, then line) is looked at.
A line goes if a line that stays stands before it within the bound, so in a chain of lines, each
near the one before, no line goes for one that goes, and no line is left that is within the bound of
one that stays before it. It goes for the earliest of those one edit away (a word changed, added or
left out), or else for the earliest one. With exhaustive=False only the first step of this is done: a
line whose first partner has a partner itself stays. The bound follows from the words n of the shorter
line: 0 below EDITED, 1 from there on, and n // EVERY from FAR on. A line that goes names a line that stays.

1. Each line becomes a 128-bit hash; of equal lines only the earliest goes on.
   Which hashes occur more than once is found by shuffling the hashes alone, and kept as a
   table of bits; only lines that it may hold are grouped.
2. Two lines within one edit share their first or last h words, h being half the shortest
   length of the shorter one's class of lengths (CLASSES). Only lines that share such a
   run with another go on (nothing else can have a partner).
3. Deletion neighbourhood: those lines emit the hash of every variant with one word left
   out where the lines may differ, with its place (for changed words) and without it (for
   words added or left out), and their own hash.
4. Lines with an equal variant at one place are all within one edit of each other, and a
   line with a variant equal to another line is within one edit of it: so the earliest of
   each group is enough of a partner, and no pairs are emitted.
5. For two edits or more: k edits leave a run of (n - k) / (k + 1) words of the shorter
   line's n untouched, RUN words at least. Of every GRAM words in a row in such a run the
   least hash is kept (winnowing), so that two such lines share a kept hash.
6. Lines that share one are compared within units of two blocks of BLOCK lines at most, by
   their lengths and by how often their words fall in each of BAG classes: k edits change
   these counts by 2 k at most. No pair within the bound is lost. Units that hold the same
   lines, as near copies share many hashes, are one from here on. The lines of a unit that
   may have a partner there come back with their words, and each that has no line one word
   away takes the earliest one that a banded word distance finds within the bound.
7. A line whose partner has none goes. One whose partner goes looks for its next partner among
   the lines left; this is repeated until all lines are decided, and each round works on the
   undecided lines and what shares a variant or a unit with them. Once that is AT_ONCE rows
   or less, one task decides these lines one after the other.

The same is done with the hashes of steps 2 to 5: only those that occur more than once are joined. The words of
lines in steps 3, 6 and 7 are found in a second scan through a bit table of their places.

Defined results: null and empty texts have no lines; lines of any length are taken
whole; rows with equal doc_id and text are one document, and keep the same lines;
a null doc_id comes after all others; an empty table gives no rows; columns but
doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _B, _B_INV, PIECE, bits_in, bits_of, characters, codes, fresh, in_bits, materialise, mix, normal, repeated, rows_of, span_hashes, unpacked, with_keys

EDITED = 8
#: Words for each edit allowed; from FAR words on it is two or more.
EVERY = 20
FAR = 2 * EVERY
#: ceil((FAR - 2) / 3), and more for longer lines.
RUN, GRAM = 13, 6
#: Classes of words; lines of a block, of LEAST words each (fewer longer ones: a block is bounded by its words).
BAG, BLOCK, LEAST = 32, 2048, 64
#: Partners that a line tries at once.
TRY = 64
#: Rows (and LEAST times as many characters) of undecided lines and their possible partners that one task decides.
AT_ONCE = 1 << 18
_C = 0xC2B2AE3D27D4EB4F | 1

#: The least length of each class of lengths, each half as long again as the one before.
CLASSES = [EDITED]
while CLASSES[-1] < 1 << 30:
    CLASSES.append(CLASSES[-1] * 3 // 2)
LAST = (1 << 63) - 1

LINES = "doc_id long, doc_hash long, line int, h1 long, h2 long, n int, p long, s long, p1 long, s1 long, keys array<long>, bag binary"
PLACE = ["id", "doc_hash", "line", "h1", "h2"]
UNIT = ["key", "i", "j", "blk", "n", "bag", "h1", "h2"]
UNITS = "key long, i int, j int, blk int, h1 long, h2 long"


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(max(n, 1), base, dtype=np.uint64))])[: n + 1]


def windows(text: str) -> Iterator[str]:
    """The text in windows of about a megabyte that end after a line or a space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = max(text.rfind("\n", at, end), text.rfind(" ", at, end))
            if cut < 0:
                cut = min((x for x in (text.find("\n", end), text.find(" ", end)) if x >= 0), default=len(text) - 1)
            end = cut + 1
        yield text[at:end]
        at = end


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the text (as normal() has it), and the number of its line."""
    word, lower = characters()
    hashes, lines, before = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], 0
    for part in windows(text):
        code = codes(part)
        edge = np.diff(word[code].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.flatnonzero(code == 10)
        hashes.append(span_hashes(lower[code], starts, ends))
        lines.append(np.searchsorted(breaks, starts) + before)
        before += len(breaks)
    return np.concatenate(hashes), np.concatenate(lines)


def bound(n):
    """How many edits a line may be away from another, the shorter of them having n words."""
    return np.where(n >= FAR, n // EVERY, np.where(n >= EDITED, 1, 0))


def lines_in(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line of the texts with a word: its text, its number, and a row of its 128-bit hash, its
    number of words, and the hashes of its first and last h words, twice: for its class of lengths, and for the class below
    (0 unless its length is the least of its class); and all words, with the place of each line's first. All lines
    are hashed by the same few array operations.
    """
    words, line = words_of("\n".join(texts))
    start = np.flatnonzero(np.diff(line, prepend=-1))
    count = np.diff(start, append=len(words))
    at = np.arange(len(words)) - np.repeat(start, count)
    most = int(count.max(initial=0))
    up, down = powers(_B, most), powers(_B_INV, most)
    zero = np.zeros(1, dtype=np.uint64)
    sums = np.concatenate([zero, np.cumsum(words * up[at])])
    other = np.concatenate([zero, np.cumsum(words * powers(_C, most)[at])])
    line, end = line[start], start + count
    n = count.astype(np.uint64)
    columns = [mix(sums[end] - sums[start] + n), mix(other[end] - other[start] + n), n]
    for h, used in zip(runs(count), (count >= EDITED, np.isin(count, CLASSES[1:]))):
        h = np.where(used, h, 0)
        tag = h.astype(np.uint64) * np.uint64(4)
        columns.append(np.where(used, mix(sums[start + h] - sums[start] + tag + np.uint64(1)), zero))
        columns.append(np.where(used, mix((sums[end] - sums[end - h]) * down[count - h] + tag + np.uint64(2)), zero))
    first = np.cumsum([0, *(x.count("\n") + 1 for x in texts)])
    row = np.searchsorted(first, line, "right") - 1
    return row, line - first[row], np.stack(columns, axis=1).view(np.int64), words, start


def runs(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the first and last run that a line of so many words shares: by its class, and by the class below."""
    of = np.searchsorted(CLASSES, count, "right") - 1
    half = np.array(CLASSES) // 2
    return half[np.maximum(of, 0)], half[np.maximum(of - 1, 0)]


def kept_grams(words: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each line the kept hashes of its runs of GRAM words, and its bag; nothing for lines of less than FAR words."""
    far = np.flatnonzero(count >= FAR)
    sizes, kept = np.zeros(len(start) + 1, dtype=np.int32), np.empty(0, dtype=np.uint64)
    if len(far):
        gram = np.zeros(len(words) - GRAM + 1, dtype=np.uint64)
        for j in range(GRAM):
            gram = gram * np.uint64(_B) + words[j : j + len(gram)]
        gram = mix(gram)
        n = len(words) - RUN + 1
        least = gram[:n].copy()
        for j in range(1, RUN - GRAM + 1):
            np.minimum(least, gram[j : j + n], out=least)
        inside = np.zeros(n + 1, dtype=np.int8)
        inside[start[far]] += 1
        inside[start[far] + count[far] - RUN + 1] -= 1
        new = np.ones(n, dtype=bool)
        new[1:] = least[1:] != least[:-1]
        new[start[far]] = True
        at = np.flatnonzero(new & (np.cumsum(inside[:n]) > 0))
        kept = least[at]
        sizes[far + 1] = np.bincount(np.searchsorted(start[far], at, "right") - 1, minlength=len(far))
    keys = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(kept.view(np.int64)))
    return keys, bags(words, start, count)


def bags(words: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.Array:
    """For each line how many of its words (modulo 256) are of each class; nothing for lines of less than FAR words."""
    far = np.flatnonzero(count >= FAR)
    bytes_ = np.zeros(len(start) + 1, dtype=np.int32)
    bytes_[far + 1] = BAG
    owner = np.repeat(np.arange(len(far)), count[far])
    place = np.repeat(start[far] - np.cumsum(count[far]) + count[far], count[far]) + np.arange(len(owner))
    classes = (words[place] & np.uint64(BAG - 1)).astype(np.int64)
    made = np.bincount(owner * BAG + classes, minlength=len(far) * BAG).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.cumsum(bytes_, dtype=np.int32)), pa.py_buffer(made)])


def variants(words: np.ndarray, first: bool, second: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines of one length (a row each), hashes of each without one word: with the word's place, and without; and of
    each as it is. first: another line has its first run."""
    n = words.shape[1]
    h = int(runs(np.array([n]))[1 if n in CLASSES[1:] else 0][0])
    up, down = powers(_B, n), np.uint64(_B_INV)
    sums = np.concatenate([np.zeros((len(words), 1), dtype=np.uint64), np.cumsum(words * up[:n], axis=1, dtype=np.uint64)], axis=1)
    at = np.arange(0 if second else h, n if first else n - h)
    left = sums[:, at] + (sums[:, n:] - sums[:, at + 1]) * down + np.uint64(n - 1)
    placed = left * np.uint64(_C) + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(n * 2 + 1)
    return mix(placed ^ np.uint64(0x5555555555555555)).view(np.int64), mix(left).view(np.int64), mix(sums[:, n] + np.uint64(n)).view(np.int64)


def lines_of(text: str) -> Iterator[tuple[int, str]]:
    for i, line in enumerate(text.split("\n")):
        words = normal(line)
        if words:
            yield i, words


def found_in(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a batch of documents, and lines_in() them."""
    texts = batch.column("text").to_pylist()
    return texts, *lines_in(texts)


def every_line(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, PIECE):
            _, row, number, h, words, start = found_in(batch)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("doc_hash").take(take), pa.array(number.astype(np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1]),
                 pa.array(h[:, 2].astype(np.int32)), *(pa.array(h[:, c], mask=h[:, c] == 0) for c in range(3, 7)), *kept_grams(words, start, h[:, 2])],
                names=[x.split()[0] for x in LINES.split(", ")],
            )

    return with_keys(docs).mapInArrow(run, LINES)


def distance(w: list[str], v: list[str], most: int) -> int | None:
    """The word edit distance if it is most or less: how far each number of edits reaches on each diagonal from which
    the edits left can still come back to the last one."""
    n, m = len(w), len(v)
    gap, off = m - n, most + 1
    reach = [-2] * (2 * off + 1)
    for edits in range(most + 1):
        now = [-2] * (2 * off + 1)
        for d in range(max(-edits, gap - most + edits), min(edits, gap + most - edits) + 1):  # d words more of v than of w
            x = d + off
            i = max(reach[x] + 1, reach[x + 1] + 1, reach[x - 1]) if edits else 0
            end = n if n < m - d else m - d
            if i > end:
                i = end
            if i < 0 or i + d < 0:
                continue
            while i < end and w[i] == v[i + d]:
                i += 1
            now[x] = i
        if abs(gap) <= edits and now[gap + off] == n:
            return edits
        reach = now
    return None


def by_unit(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[pa.Table, dict[str, np.ndarray], np.ndarray]]:
    """Tables of whole units from batches sorted by key, i and j: the table, some columns, and where each row's unit ends."""
    held: list[pa.RecordBatch] = []

    def made(table: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray], np.ndarray]:
        c = {x: table.column(x).to_numpy() for x in ("key", "i", "j", *names)}
        new = np.ones(table.num_rows + 1, dtype=bool)
        new[1:-1] = (c["key"][1:] != c["key"][:-1]) | (c["i"][1:] != c["i"][:-1]) | (c["j"][1:] != c["j"][:-1])
        return table, c, np.repeat(np.flatnonzero(new)[1:], np.diff(np.flatnonzero(new)))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(x)[-1].as_py() for x in ("key", "i", "j")]
        if [held[0].column(x)[0].as_py() for x in ("key", "i", "j")] == last:
            continue  # sorted, so all that is held is of one unit
        table = pa.Table.from_batches(held)
        c = [table.column(x).to_numpy() for x in ("key", "i", "j")]
        cut = np.flatnonzero((c[0] != last[0]) | (c[1] != last[1]) | (c[2] != last[2]))
        yield made(table.slice(0, cut[-1] + 1))
        held = table.slice(cut[-1] + 1).combine_chunks().to_batches()
    if held:
        yield made(pa.Table.from_batches(held))


def may_pair(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows of one unit its lengths, blocks and bags allow."""
    n, m = c["n"][x], c["n"][y]
    k = np.minimum(n, m) // EVERY
    ok = (np.abs(n - m) <= k) & ((c["i"][x] == c["j"][x]) | (c["blk"][x] != c["blk"][y]))
    at = np.flatnonzero(ok)
    gap = c["bag"][x[at]] - c["bag"][y[at]]
    ok[at] = np.minimum(gap, -gap).sum(axis=1, dtype=np.int64) <= 2 * k[at]
    return ok


def bags_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("bag").to_pylist()), dtype=np.uint8).reshape(-1, BAG)


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit that lengths and bags allow a partner in it. Batches are sorted by key, i, j, h1 and h2.

    Near copies share many kept hashes, so many units hold the same lines: from here on a unit's key is a hash of its
    lines, and of the block of each if its pairs are those between two blocks. Units that meet by chance only have more to compare.
    """
    for table, c, end in by_unit(batches, ("n", "blk", "h1", "h2")):
        c["bag"] = bags_of(table)
        twin = np.zeros(len(end), dtype=bool)  # a line that came twice
        twin[1:] = (end[1:] == end[:-1]) & (c["h1"][1:] == c["h1"][:-1]) & (c["h2"][1:] == c["h2"][:-1])
        y, met = np.arange(len(end)), np.zeros(len(end), dtype=bool)
        for off in range(1, len(end)):
            y = y[y + off < end[y]]
            if not len(y):
                break
            b = y[~(met[y] & met[y + off] | twin[y] | twin[y + off])]
            b = b[may_pair(c, b + off, b)]
            met[b] = met[b + off] = True
        if not met.any():
            continue
        end, h1, h2 = end[met], c["h1"][met], c["h2"][met]
        two = c["i"][met] != c["j"][met]
        blk = (two & (c["blk"][met] == c["j"][met])).astype(np.int32)
        start = np.flatnonzero(np.diff(end, prepend=-1))
        own = mix(h1.view(np.uint64) * np.uint64(_B) + h2.view(np.uint64) * np.uint64(_C) + blk.astype(np.uint64))
        key = np.repeat(mix(np.add.reduceat(own, start)).view(np.int64), np.diff(start, append=len(end)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.zeros(len(key), dtype=np.int32), two.astype(np.int32), blk, h1, h2)], names=[x.split()[0] for x in UNITS.split(", ")])


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rank, y and edits: of each line of a unit that asks, the earliest line before it within the bound. Batches are
    sorted by key, i, j and rank."""
    for table, c, end in by_unit(batches, ("rank", "n", "blk", "asks")):
        c["bag"] = bags_of(table)
        y, first = np.arange(len(end)), np.full(len(end), -1)
        for off in range(1, len(end)):
            y = y[y + off < end[y]]
            if not len(y):
                break
            b = y[c["asks"][y + off]]
            b = b[may_pair(c, b + off, b)]
            first[b + off] = b  # longer ways come later, so the earliest line is written last
        words = table.column("words").combine_chunks()
        out: list[tuple[int, int, int]] = []
        for x in np.flatnonzero(first >= 0).tolist():
            w = words[x].as_py().split(" ")
            for b in possible(c, x, int(first[x])):
                v = words[b].as_py().split(" ")
                edits = distance(w, v, min(len(w), len(v)) // EVERY)
                if edits is not None:
                    out.append((c["rank"][x], c["rank"][b], edits))
                    break
        a, b, edits = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(edits, pa.int32())], names=["rank", "y", "edits"])


def possible(c: dict[str, np.ndarray], x: int, first: int) -> Iterator[int]:
    """The row `first` of x's unit and those between it and x that lengths and bags allow, found TRY at a time."""
    yield first
    for at in range(first + 1, x, TRY):
        y = np.arange(at, min(x, at + TRY))
        yield from y[may_pair(c, np.full(len(y), x), y)].tolist()


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rank, y and edits of the undecided lines that go, decided one after the other: kind 0 to 2 are variants, 3 the rows of
    units, 4 the lines' words and 5 the undecided lines."""
    held = [x.to_pydict() for x in batches]
    rows = [x for part in held for x in zip(*(part[c] for c in ("kind", "key", "i", "j", "rank", "words")))]
    words = {rank: text.split(" ") for kind, _, _, _, rank, text in rows if kind == 4}
    undecided = {rank for kind, *_, rank, _ in rows if kind == 5}
    members: dict[tuple, list[int]] = {}
    own: dict[int, list[tuple]] = {x: [] for x in undecided}
    for kind, key, i, j, rank, _ in rows:
        if kind < 4:
            members.setdefault((kind, key, i, j), []).append(rank)
            if rank in undecided:
                own[rank].append(({1: 2, 2: 1}.get(kind, kind), key, i, j))
    gone: dict[int, tuple[int, int]] = {}
    for x in sorted(undecided):
        for near in (True, False):
            others = {y for group in own[x] if (group[0] < 3) == near for y in members.get(group, ()) if y < x and y not in gone}
            w = words[x]
            found = next(((y, edits) for y in sorted(others) if (edits := distance(w, v := words[y], 1 if near else min(len(w), len(v)) // EVERY)) is not None), None)
            if found:
                gone[x] = found
                break
    a, b = list(gone), list(gone.values())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([y for y, _ in b], pa.int64()), pa.array([edits for _, edits in b], pa.int32())], names=["rank", "y", "edits"])


def units(rows: DataFrame) -> DataFrame:
    """The rows dealt to the units of their two blocks, each unit in one task."""
    dealt = rows.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o"))
    return in_units(dealt.select(*UNIT), "h1", "h2")


def in_units(rows: DataFrame, *order: str) -> DataFrame:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", *order)


def place_hash() -> Column:
    """A hash of a line's document and number; its neighbours' differ above the lowest six bits."""
    return F.col("doc_hash").bitwiseXOR(F.shiftleft(F.col("line").cast("long"), 6)).alias("at")


class Lines:
    """All lines, and which of them occur more than once.

    lines: each line. again: those whose hash occurs more than once (and a few more). heads: of each group of equal ones
    among them the earliest. goes_on(): whether a line of a batch is the earliest of its equals; no such line is missed, and
    a few others pass.
    """

    def __init__(self, docs: DataFrame):
        sc = docs.sparkSession.sparkContext
        self.lines = materialise(every_line(docs))
        table = sc.broadcast(bits_in(repeated(self.lines.select("h1"), _hashes)))
        own = ["doc_id", "doc_hash", "line", "h1", "h2"]

        def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(table.value, dtype=np.int64)
            for batch in rows_of(batches):
                yield batch.filter(pa.array(in_bits(bits, batch.column("h1").to_numpy())))

        self.again = materialise(self.lines.select(*own).mapInArrow(twice, "doc_id long, doc_hash long, line int, h1 long, h2 long"))
        self.heads = materialise(self.again.groupBy("h1", "h2").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "doc_hash", "line")).alias("x")).select("h1", "h2", "x.*"))
        head = sc.broadcast(bits_of(self.heads.select(place_hash()), "at", 64))

        def goes_on(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            """Which lines go on, and which occur more than once."""
            often = in_bits(np.frombuffer(table.value, dtype=np.int64), batch.column("h1").to_numpy())
            at = batch.column("doc_hash").to_numpy() ^ (batch.column("line").to_numpy().astype(np.int64) << 6)
            return ~often | in_bits(np.frombuffer(head.value, dtype=np.int64), at), often

        self.goes_on = goes_on


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column(0).to_numpy()
    return values, np.zeros(len(values), dtype=np.int64)


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and last runs of the lines of a batch: hash, row, and whether it is a first one."""
    columns = [batch.column(x) for x in ("p", "s", "p1", "s1")]
    there = [np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)) for x in columns]
    return np.concatenate([x.drop_null().to_numpy() for x in columns]), np.concatenate(there), np.repeat([True, False, True, False], [len(x) for x in there])


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes of the lines of a batch, each once for a line, and their rows."""
    lists = batch.column("keys")
    row, key = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return key[new], row[new]


class Partners:
    """The lines that may have partners, numbered in order, and their partners among those that aren't gone."""

    def __init__(self, docs: DataFrame, all_: Lines):
        goes_on = all_.goes_on
        long_ = all_.lines.where(F.col("n") >= EDITED)

        def hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            batch = batch.filter(pa.array(goes_on(batch)[0]))
            (run, _, _), (key, row) = _runs(batch), _keys(batch)
            size = np.maximum(batch.column("n").to_numpy(), LEAST).astype(np.int64)
            return np.concatenate([run, key]), np.concatenate([np.zeros(len(run), dtype=np.int64), size[row]])

        runs_ = ["doc_hash", "line", "h1", "h2", "p", "s", "p1", "s1"]
        packed = repeated(long_.select(*runs_, "n", "keys"), hashes)
        table, shared = docs.sparkSession.sparkContext.broadcast(bits_in(packed)), unpacked(packed)

        def run_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(table.value, dtype=np.int64)
            for batch in rows_of(batches):
                batch = batch.filter(pa.array(goes_on(batch)[0]))
                run, row, is_first = _runs(batch)
                hit = in_bits(bits, run)
                take = pa.array(row[hit])
                yield pa.RecordBatch.from_arrays([pa.array(run[hit]), pa.array(is_first[hit]), *(batch.column(x).take(take) for x in ("h1", "h2"))], names=["key", "p", "h1", "h2"])

        def key_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(table.value, dtype=np.int64)
            for batch in rows_of(batches, PIECE):
                batch = batch.filter(pa.array(goes_on(batch)[0]))
                key, row = _keys(batch)
                hit = in_bits(bits, key)
                take = pa.array(row[hit])
                yield pa.RecordBatch.from_arrays([pa.array(key[hit]), *(batch.column(x).take(take) for x in own)], names=["key", *own])

        own = ["h1", "h2", "n", "bag"]
        near = long_.select(*runs_).mapInArrow(run_hits, "key long, p boolean, h1 long, h2 long").join(shared.select("key"), "key")
        near = near.groupBy("h1", "h2").agg(F.bool_or("p").alias("first"), F.bool_or(~F.col("p")).alias("second"), F.lit(False).alias("far"))
        rows = long_.where(F.col("n") >= FAR).select("doc_hash", "line", *own, "keys").mapInArrow(key_hits, "key long, h1 long, h2 long, n int, bag binary").join(shared, "key")
        rows = rows.withColumn("blocks", F.ceil(F.col("size") / (BLOCK * LEAST)).cast("int")).withColumn("blk", F.pmod(F.col("h2"), F.col("blocks")).cast("int"))
        met = materialise(units(rows).mapInArrow(alike, UNITS).dropDuplicates(["key", "i", "j", "blk", "h1", "h2"]))
        members = met.select("h1", "h2").distinct().select("h1", "h2", F.lit(False).alias("first"), F.lit(False).alias("second"), F.lit(True).alias("far"))
        alive = materialise(near.unionByName(members).groupBy("h1", "h2").agg(*[F.bool_or(x).alias(x) for x in ("first", "second", "far")]))
        self.lines = self._found_again(docs, all_, alive)
        self.far = materialise(met.join(self.lines.where("far").select("h1", "h2", "rank"), ["h1", "h2"]).drop("h1", "h2"))
        every = materialise(self.lines.where("first or second").select("rank", "words", "first", "second").mapInArrow(_emit, "key long, kind byte, rank long"))
        again = docs.sparkSession.sparkContext.broadcast(bits_in(repeated(every.select("key"), _hashes)))

        def met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(again.value, dtype=np.int64)
            for batch in rows_of(batches):
                yield batch.filter(pa.array(in_bits(bits, batch.column("key").to_numpy())))

        self.rows = materialise(every.mapInArrow(met_again, "key long, kind byte, rank long"))

    @staticmethod
    def _found_again(docs: DataFrame, all_: Lines, alive: DataFrame) -> DataFrame:
        """The words of the lines that go on, and their numbers in order."""
        goes_on, sc = all_.goes_on, docs.sparkSession.sparkContext
        hashes = sc.broadcast(bits_of(alive, "h1"))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(hashes.value, dtype=np.int64)
            for batch in rows_of(batches):
                batch = batch.filter(pa.array(in_bits(bits, batch.column("h1").to_numpy())))
                go, often = goes_on(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(often)], names=[*batch.schema.names, "often"]).filter(pa.array(go))

        at = all_.lines.where(F.col("n") >= EDITED).select("doc_id", "doc_hash", "line", "h1", "h2")
        at = at.mapInArrow(placed, "doc_id long, doc_hash long, line int, h1 long, h2 long, often boolean")
        earliest = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "doc_hash", "line", "doc_id", "often")).alias("x")
        wanted = materialise(alive.join(at.groupBy("h1", "h2").agg(earliest).select("h1", "h2", "x.*"), ["h1", "h2"]))
        places = sc.broadcast(bits_of(wanted.select(place_hash()), "at", 64))

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places_ = np.frombuffer(places.value, dtype=np.int64)
            for batch in rows_of(batches, PIECE):
                hashes_, own = batch.column("doc_hash").to_numpy(), [x.split("\n") for x in batch.column("text").to_pylist()]
                count = np.array([len(x) for x in own])
                row = np.repeat(np.arange(len(own)), count)
                number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                hit = np.flatnonzero(in_bits(places_, hashes_[row] ^ (number << 6)))
                row, number = row[hit], number[hit]
                picked = [own[r][i] for r, i in zip(row.tolist(), number.tolist())]
                at, _, h, every, start = lines_in(picked)  # a line without words has no row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes_[row[at]]), pa.array(number[at].astype(np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1]),
                     pa.array(h[:, 2].astype(np.int32)), bags(every, start, h[:, 2]), pa.array([normal(picked[i]) for i in at.tolist()], pa.string())],
                    names=["doc_hash", "line", "h1", "h2", "n", "bag", "words"],
                )

        texts = with_keys(docs).mapInArrow(again, "doc_hash long, line int, h1 long, h2 long, n int, bag binary, words string")
        found = texts.join(wanted, ["h1", "h2", "doc_hash", "line"]).dropDuplicates(["h1", "h2"])
        # the numbers of a sorted table rise with its rows
        return materialise(found.orderBy(*PLACE).withColumn("rank", F.monotonically_increasing_id()))

    def near(self, gone: DataFrame | None, open_: DataFrame | None) -> DataFrame:
        """rank, y and edits: the earliest line one word away, of all lines or of the open ones."""
        rows = self.rows if gone is None else self.rows.join(gone, "rank", "left_anti")
        of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("rank")))
        least = materialise(rows.groupBy("key").agg(of(0).alias("placed"), of(1).alias("longer"), of(2).alias("whole"), F.count("*").alias("c")).where("c > 1"))
        partner = F.when(F.col("kind") == 0, F.col("placed")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("longer"))
        if open_ is not None:
            rows = rows.join(open_, "rank", "left_semi")
        found = rows.join(least, "key").withColumn("y", partner).where("y < rank").groupBy("rank").agg(F.min("y").alias("y"))
        words = self.lines.where("first or second").select("rank", F.col("words").alias("w"))
        met = found.join(words, "rank").join(words.select(F.col("rank").alias("y"), F.col("w").alias("v")), "y")
        return materialise(met.select("rank", "y", "w", "v").mapInArrow(confirmed, "rank long, y long, edits int"))

    def partners(self, gone: DataFrame | None, open_: DataFrame | None) -> DataFrame:
        """rank, y and edits of those lines, or open ones, that have a partner that isn't gone."""
        near = self.near(gone, open_)
        far = self.lines.where("far")
        asks = (far if open_ is None else far.join(open_, "rank", "left_semi")).join(near, "rank", "left_anti").select("rank", F.lit(True).alias("asks"))
        words = far.select("rank", "words", "n", "bag").join(asks, "rank", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        rows = self.far.join(words if gone is None else words.join(gone, "rank", "left_anti"), "rank")
        found = in_units(rows, "rank").mapInArrow(settled, "rank long, y long, edits int").groupBy("rank").agg(F.min("y").alias("y"), F.min_by("edits", "y").alias("edits"))
        return materialise(near.unionByName(found))

    def _only(self, undecided: DataFrame, gone: DataFrame) -> None:
        """From here on, what no undecided line has to do with is out of the way, and what is gone too."""
        keys = self.rows.join(undecided, "rank", "left_semi").select("key").distinct()
        self.rows = materialise(self.rows.join(gone, "rank", "left_anti").join(keys, "key", "left_semi"))
        own = self.far.join(undecided, "rank", "left_semi").select("key", "i", "j").distinct()
        self.far = materialise(self.far.join(gone, "rank", "left_anti").join(own, ["key", "i", "j"], "left_semi"))

    def _at_once(self, undecided: DataFrame) -> DataFrame | None:
        """rank, y and edits of the undecided lines that go, if all that they have to do with fits one task."""
        many = self.rows.count() + self.far.count()
        if many > AT_ONCE:
            return None
        zero, none = F.lit(0), F.lit(None).cast("string").alias("words")
        groups = self.rows.select("kind", "key", zero.alias("i"), zero.alias("j"), "rank", none).unionByName(self.far.select(F.lit(3).alias("kind"), "key", "i", "j", "rank", none))
        lines = self.lines.select("rank", "words").join(groups.select("rank").distinct(), "rank", "left_semi")
        size = lines.agg(F.sum(F.length("words"))).first()[0] or 0
        if size > AT_ONCE * LEAST:
            return None
        whole = lambda df, kind, text: df.select(F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("key"), zero.alias("i"), zero.alias("j"), "rank", text)
        rows = groups.unionByName(whole(lines, 4, F.col("words"))).unionByName(whole(undecided, 5, none))
        return materialise(rows.repartition(1).mapInArrow(decide, "rank long, y long, edits int"))

    def decided(self, exhaustive: bool) -> DataFrame:
        """rank, y and edits of each line that goes, y being a line that stays."""
        open_, gone = self.partners(None, None), None
        while True:
            # a partner that is neither undecided nor gone stays
            stays = open_.join(open_.select(F.col("rank").alias("y")), "y", "left_anti")
            if gone is not None:
                stays = stays.join(gone.select(F.col("rank").alias("y")), "y", "left_anti")
            now = stays.select("rank", "y", "edits")
            gone = materialise(now if gone is None else gone.unionByName(now))
            if not exhaustive:
                return gone
            rest = materialise(open_.join(gone, "rank", "left_anti"))
            if not rest.limit(1).count():
                return gone
            self._only(rest.select("rank"), gone.select("rank"))
            rounds = self._at_once(rest.select("rank"))
            if rounds is not None:
                return gone.unionByName(rounds)
            lost = gone.select(F.col("rank").alias("y"))
            again = materialise(rest.join(lost, "y", "left_semi").select("rank"))
            waiting = rest.join(lost, "y", "left_anti").select("rank", "y", "edits")
            open_ = materialise(waiting.unionByName(self.partners(gone.select("rank"), again)))


def emitted(lines: list[str], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, kind (0 with its place, 1 without, 2 a line itself) and line of every variant; a line's equal variants come once."""
    words, line = words_of("\n".join(lines))
    start = np.flatnonzero(np.diff(line, prepend=-1))
    count, line = np.diff(start, append=len(words)), line[start]
    first, second = first[line], second[line]
    sort = count * 4 + first * 2 + second
    key, kind, row = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int8)], [np.empty(0, dtype=np.int64)]
    for x in np.unique(sort):
        of = np.flatnonzero(sort == x)
        n = int(count[of[0]])
        step = max(1, (1 << 18) // n)  # what is held at once is bounded by words, not by lines
        for own in (of[i : i + step] for i in range(0, len(of), step)):
            placed, loose, whole = variants(words[start[own][:, None] + np.arange(n)], bool(first[own[0]]), bool(second[own[0]]))
            loose = np.sort(loose, axis=1)
            new = np.ones(loose.shape, dtype=bool)
            new[:, 1:] = loose[:, 1:] != loose[:, :-1]
            for part, rows, k in ((placed.ravel(), np.repeat(own, placed.shape[1]), 0), (loose[new], np.repeat(own, new.sum(axis=1)), 1), (whole, own, 2)):
                key.append(part)
                kind.append(np.full(len(part), k, dtype=np.int8))
                row.append(line[rows])
    return np.concatenate(key), np.concatenate(kind), np.concatenate(row)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches, 1 << 18):
        key, kind, row = emitted(batch.column("words").to_pylist(), *(np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in ("first", "second")))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), batch.column("rank").take(pa.array(row))], names=["key", "kind", "rank"])


def within_one(w: str, v: str) -> bool:
    """Whether two lines are within one edit: what follows the first difference is equal but for one word."""
    a, b = w.split(" "), v.split(" ")
    if abs(len(a) - len(b)) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[at + (len(a) >= len(b)) :] == b[at + (len(b) >= len(a)) :]


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rank, y and edits of the rows whose lines w and v are within one edit."""
    for batch in rows_of(batches):
        ok = pa.array([within_one(w, v) for w, v in zip(batch.column("w").to_pylist(), batch.column("v").to_pylist())], pa.bool_())
        x = batch.filter(ok)
        yield pa.RecordBatch.from_arrays([x.column("rank"), x.column("y"), pa.array(np.ones(x.num_rows, dtype=np.int32))], names=["rank", "y", "edits"])


def dropped_lines(docs: DataFrame, exhaustive: bool = False) -> DataFrame:
    """doc_id, doc_hash, line (from 0) of each line that goes, and the earlier line, which stays, that it repeats, with the edits between them."""
    all_ = Lines(docs)
    found = Partners(docs, all_)
    at = found.lines.select(F.col("rank").alias("y"), F.col("id").alias("near_id"), F.col("line").alias("near_line"))
    own = found.lines.select("rank", "doc_id", "doc_hash", "line", "h1", "h2", "often")
    near = materialise(found.decided(exhaustive).join(at, "y").join(own, "rank"))
    heads = all_.heads.select("h1", "h2", F.col("id").alias("first_id"), F.col("doc_hash").alias("first_hash"), F.col("line").alias("first_line"))
    kept = heads.join(near.where("often").select("h1", "h2", "near_id", "near_line", "edits"), ["h1", "h2"], "left")
    itself = (F.col("doc_hash") == F.col("first_hash")) & (F.col("line") == F.col("first_line"))
    goes = F.col("near_line").isNotNull()
    to = F.when(goes, F.col("near_id")).otherwise(F.col("first_id"))
    often = (
        all_.again.join(kept, ["h1", "h2"])
        .where(~itself | goes)
        .select(
            "doc_id", "doc_hash", "line", F.when(to < LAST, to).alias("kept_doc_id"),
            F.when(goes, F.col("near_line")).otherwise(F.col("first_line")).alias("kept_line"), F.coalesce("edits", F.lit(0)).alias("edits"),
        )
    )
    once = near.where(~F.col("often")).select("doc_id", "doc_hash", "line", F.when(F.col("near_id") < LAST, F.col("near_id")).alias("kept_doc_id"), F.col("near_line").alias("kept_line"), "edits")
    return often.unionByName(once)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go, with n_chars counted anew; other columns as they are, whatever their names.

    A document that loses lines and has no letter or digit left goes; others stay.
    """
    own, gone, gone_id, gone_hash = fresh(docs, "own_hash", "gone", "gone_id", "gone_hash")
    found = dropped_lines(docs, exhaustive=True).groupBy("doc_id", "doc_hash").agg(F.collect_set("line").alias(gone))
    keyed = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    both = keyed.join(found.select(F.col("doc_id").alias(gone_id), F.col("doc_hash").alias(gone_hash), gone), (F.col(own) == F.col(gone_hash)) & F.col("doc_id").eqNullSafe(F.col(gone_id)), "left")
    rest = F.expr(f"transform(array(split(text, '\\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), `{gone}`), i -> l[i]), '\\n'))[0]")
    made = both.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest))
    made = made.where(F.col(gone).isNull() | F.col("text").rlike(r"[\p{L}\p{N}]"))
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
