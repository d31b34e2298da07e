"""Operator 1: byte-level BPE encoding and decoding.

Ranks of a ``.tiktoken`` file become a BPE model of the ``tokenizers`` library:
each byte is written as one printable character (the usual byte-to-character
table), and every pair of tokens whose bytes join to a token is a merge, in the
order of ranks. Text is cut by the vocabulary's pattern, and each match is
encoded by itself through the model, which also gives offsets.

Speed: a text is first cut at single spaces between two characters that aren't
white space. No match of the pattern crosses such a place and none looks beyond
it, so the parts can be encoded once each and remembered (a bounded table in
each Python worker). Decoding looks each id up in the byte table and joins the
bytes; characters that two tokens split come together there, and bytes that
aren't valid UTF-8 (possible for lists of ids that no text gives) become U+FFFD
in text.

Defined results: a null text is the empty text, with no tokens; texts of any
length are encoded whole; repeated rows give repeated rows; an empty table gives
an empty table; a null doc_id stays null; columns but doc_id and text don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import REMEMBERED as KEPT_BY_WORKERS
from .common import rows_of

#: Parts of texts that a worker remembers; the table is emptied when full.
REMEMBERED = 1_000_000
#: Bytes of text whose unknown matches go to the library in one call.
BATCH = 4 << 20
#: Longer parts aren't remembered.
LONGEST = 256

#: Where white space meets white space or an end of the text, parts can't be cut at each space.
_ODD = re.compile(r"\s\s|^\s|\s$")
_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> dict[int, str]:
    """The byte-to-character table of byte-level BPE: printable Latin-1 bytes are themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes by the ranks of one file."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.chars = byte_characters()
        spelled = {t: self.spell(t) for t in ranks}
        merges = [
            (spelled[t[:i]], spelled[t[i:]])
            for t in sorted(ranks, key=ranks.__getitem__)
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        self.model = models.BPE(vocab={spelled[t]: i for t, i in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(self.model)
        self.find = regex.compile(pattern).findall
        self.texts_of = {str(i): t for i, t in self.bytes_of.items()}
        self.matches: dict[str, str] = {}  # ids in decimal, joined by commas
        self.parts: dict[str, str] = {"": ""}

    def spell(self, data: bytes) -> str:
        return "".join(map(self.chars.__getitem__, data))

    def cut(self, text: str) -> list[str]:
        """Parts of the text that can be encoded by themselves: no match crosses their ends or looks beyond them."""
        if _ODD.search(text):
            first, *rest = _SPACE.split(text)
            return [first, *[" " + x for x in rest]]
        out: list[str] = []
        for line in text.split("\n"):
            if out:
                out.append("\n")
            first, *rest = line.split(" ")
            out.append(first)
            out += [" " + x for x in rest]
        return out

    def learn(self, parts: set[str]) -> None:
        """Encodes parts that aren't remembered: all their unknown matches go through the library at once."""
        if len(self.matches) > REMEMBERED // 4:
            self.matches.clear()
        found = {p: self.find(p) for p in parts}
        new = list(set(chain.from_iterable(found.values())) - self.matches.keys())
        if new:
            made = self.tokenizer.encode([self.spell(m.encode()) for m in new], is_pretokenized=True, add_special_tokens=False)
            ids, ends, at = list(map(str, made.ids)), Counter(made.word_ids), 0
            for i, match in enumerate(new):
                self.matches[match] = ",".join(ids[at : at + ends[i]])
                at += ends[i]
        for part, matches in found.items():
            self.parts[part] = ",".join(map(self.matches.__getitem__, matches))

    def decimal(self, texts: list[str]) -> list[str]:
        """The ids of each text in decimal, joined by commas."""
        cut = [self.cut(x) for x in texts]
        ids = [list(map(self.parts.get, x)) for x in cut]
        short = [i for i, x in enumerate(ids) if None in x]
        new = {p for i in short for p, x in zip(cut[i], ids[i]) if x is None}
        if new:
            if len(self.parts) + len(new) > REMEMBERED:
                self.parts, new, short = {"": ""}, set(chain.from_iterable(cut)), range(len(cut))
            self.learn(new)
            for i in short:
                ids[i] = list(map(self.parts.__getitem__, cut[i]))
            for part in new:
                if len(part) > LONGEST:
                    del self.parts[part]
        return [",".join(filter(None, x)) for x in ids]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, x.split(","))) if x else [] for x in self.decimal(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each token in code points; a token inside a character covers that character."""
        out, at = [], 0
        for match in self.find(text):
            char_of = [i for i, c in enumerate(match) for _ in c.encode()]
            byte = 0
            for x in self.model.tokenize(self.spell(match.encode())):
                size = len(self.bytes_of[x.id])
                out.append((at + char_of[byte], at + char_of[byte + size - 1] + 1))
                byte += size
            at += len(match)
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_decimal(self, ids: str) -> bytes:
        return b"".join(map(self.texts_of.__getitem__, ids.split(","))) if ids else b""

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


KEPT_BY_WORKERS["bytebpe"] = codec.cache_clear


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """doc_id and ids array<int> of each text; with offsets, starts and ends in code points too."""
    schema = "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in rows_of(batches, BATCH, "bytebpe"):
            text = ["" if x is None else x for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(own.encode_batch(text), pa.list_(pa.int32()))]
            if offsets:
                spans = [own.offsets(x) for x in text]
                columns += [pa.array([[s[i] for s in x] for x in spans], pa.list_(pa.int32())) for i in (0, 1)]
            names = ["doc_id", "ids", "starts", "ends"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of each row of doc_id, ids (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in rows_of(batches, BATCH, "bytebpe"):
            text = [own.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
    ]
)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids of each text and of the bytes that those ids decode to; a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in rows_of(batches, BATCH, "bytebpe"):
            counts, id_sums, byte_sums, sizes = [], [], [], []
            for ids in own.decimal([x or "" for x in batch.column(1).to_pylist()]):
                back = own.decode_decimal(ids)
                counts.append(ids.count(",") + 1 if ids else 0)
                id_sums.append(hashlib.sha256(ids.encode()).hexdigest())
                byte_sums.append(hashlib.sha256(back).hexdigest())
                sizes.append(len(back))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums), pa.array(byte_sums), pa.array(sizes, pa.int64())],
                names=DIGESTS.names,
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, DIGESTS)
