"""Operator 9: token counts without token ids.

A sentencepiece BPE model whose pieces hold the space mark only in front can be
counted by pre-tokens: runs of spaces with what follows up to the next space.
No merge joins two of them, so the tokens of a text are the sum over its
pre-tokens. Each distinct pre-token of the corpus is counted once, by the
library itself:

1. each task gathers its distinct pre-tokens with how often they occur, and
   Spark sums these by pre-token (map-side sums first);
2. pieces are counted once for each distinct pre-token;
3. the most frequent pre-tokens (HEAD of them at most, so the size of what is
   broadcast is bounded) are added up where the text is read; the rest of each
   document's pre-token frequencies are joined to the counts by pre-token. What
   is joined is rare by construction, so no key is hot.

Defined results: null and empty texts have no tokens and no bytes; texts are
counted whole; repeated rows give repeated rows; an empty table gives an empty
table; columns but doc_id and text don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, rows_of

#: Pre-tokens whose counts every task holds; the rest are joined.
HEAD = 200_000
#: Distinct pre-tokens that a task gathers before it sends them on.
GATHERED = 500_000
#: The mark that the library writes for a space.
MARK = "▁"


def pretokens(text: str) -> list[str]:
    """The text's pre-tokens, each without its first space; the library puts one before the first."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for i, part in enumerate(parts):
        if part or i == len(parts) - 1:
            out.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    return out


@lru_cache(maxsize=4)
def model(path: str):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in own.id_to_piece(i).lstrip(MARK) for i in range(own.get_piece_size())):
        raise ValueError("a piece holds a space mark inside; its texts can't be cut at spaces")
    return own


def count_pieces(own, words: list[str]) -> list[int]:
    """Pieces of each pre-token. The empty one is a lone mark, which the library doesn't write for an empty text."""
    lone = len(own.encode(" ")) and sum(own.id_to_piece(i) == MARK for i in [own.piece_to_id(MARK)])
    lone = 1 if lone else len(MARK.encode())
    return [len(x) if w else lone for w, x in zip(words, own.encode(words, num_threads=1))]


def frequencies(docs: DataFrame) -> DataFrame:
    """Every distinct pre-token of the texts and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in rows_of(batches):
            for text in batch.column(0).to_pylist():
                seen.update(pretokens(text or ""))
                if len(seen) >= GATHERED:
                    yield table()(seen)
                    seen.clear()
        yield table()(seen)

    def table():
        return lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def counted(words: DataFrame, path: str) -> DataFrame:
    """word, n and its number of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in rows_of(batches, 1 << 20):
            found = count_pieces(own, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=["word", "n", "pieces"])

    return words.mapInArrow(run, "word string, n long, pieces int")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest classes of frequency (eight for each doubling) that hold at most so many words in all.

    A histogram of at most 512 rows sets the bound, so nothing is sorted and no task or driver sees more than it keeps.
    """
    grade = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for g, size in sorted((tuple(r) for r in counts.groupBy(grade.alias("g")).agg(F.count("*").alias("size")).collect()), reverse=True):
        held += size
        if held > most:
            break
        least = g
    return counts.where(F.lit(False) if least is None else grade >= least)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over the limit, for each row."""
    spark = docs.sparkSession
    counts = materialise(counted(frequencies(docs), path))
    top = most_frequent(counts, head).select("word", "pieces").toPandas()
    known = spark.sparkContext.broadcast(dict(zip(top["word"], top["pieces"].tolist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in rows_of(batches):
            out: list[list] = [[], [], [], [], [], []]
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                total, rest = 0, Counter()
                for word in pretokens(text):
                    pieces = get(word)
                    if pieces is None:
                        rest[word] += 1
                    else:
                        total += pieces
                # a word can't hold two spaces before this mark, so the key of the row itself joins nothing
                for line in ((row, doc_id, len(text.encode()), total, f"{MARK}{row}", 0), *((row, None, None, 0, w, n) for w, n in rest.items())):
                    for column, x in zip(out, line):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["row", "doc_id", "n_bytes", "known", "word", "times"])

    spread = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "row long, doc_id long, n_bytes long, known long, word string, times long"
    )
    return (
        spread.join(counts.select("word", "pieces"), "word", "left")
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum(F.col("known") + F.col("times") * F.coalesce(F.col("pieces"), F.lit(0))).cast("long").alias("n_tokens"),
        )
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
