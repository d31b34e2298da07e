"""The pipeline as a whole against stages in plain Python, and on tables without rows."""

import base64
import hashlib

import public_tokenizers as P
import pytest

import corpus_pipeline
from blockloom.llm import common, quality
from tests.conftest import SF
from tests.llm.test_operators import brute_classes, brute_heads, least_edits, near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, doc_hash string, gone string, score string"
LAST = (1 << 63) - 1


@pytest.fixture
def tables(spark, tmp_path):
    def made(rows, items=6):
        spark.createDataFrame([(i, t, None, "s", None, "own", "gone", None) for i, t in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(items).write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return made


def without_lines(rows):
    gone, out = brute_heads(rows), []
    for i, t in rows:
        left = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone]
        if not any(d == i for d, _ in gone):
            out.append((i, t))
        elif any(c.isalnum() for c in "".join(left)):
            out.append((i, "\n".join(left)))
    return out


def test_pipeline(spark, tables, monkeypatch):
    import tiktoken

    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(110).collect()]
    made = [None, "", "...", rows[5][1], rows[7][1] + "\nand one line more", f"before {bench[0]} after", bench[1].upper(), *near_copies(6), "é😀中文 <|endoftext|>", "the same line of eight words stands here\nx1 y1", "the same line of eight words stands there\nx2 y2"]
    rows += [(10**6 + i, t) for i, t in enumerate(made)] + [(LAST, "a document without an id, of words that no other has")]
    sf = tables([(None if i == LAST else i, t) for i, t in rows])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []

    def seen(df):
        kept.append(common.materialise(df))
        return kept[-1]

    monkeypatch.setattr(corpus_pipeline, "materialise", seen)
    last = corpus_pipeline.run(spark, sf)
    assert [x for x, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"] and len(kept) == 5
    of = lambda df: {LAST if r.doc_id is None else r.doc_id: r for r in df.collect()}
    for df in kept[:4]:
        assert df.columns == docs.columns
        assert all((r.doc_hash, r.gone, r.source, r.score) == ("own", "gone", "s", None) for r in df.collect())

    scores = of(quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    rows = [(i, t) for i, t in rows if scores[i].score >= 0.5]
    assert {i: r.text for i, r in of(kept[0]).items()} == dict(rows)
    fewer = without_lines(rows)
    assert {i: r.text for i, r in of(kept[1]).items()} == dict(fewer) and fewer != rows
    rows = [fewer[i] for i in sorted({c for c, _ in brute_classes([t for _, t in fewer])})]
    assert {i: r.text for i, r in of(kept[2]).items()} == dict(rows)
    dirty = set()
    for text in bench:
        item = common.normal(text)
        dirty |= {i for (i, _), e in zip(rows, least_edits(item, [t for _, t in rows])) if e <= int(len(item) * 0.08)}
    rows = [(i, t) for i, t in rows if i not in dirty]
    assert {i: r.text for i, r in of(kept[3]).items()} == dict(rows) and dirty
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = of(last)
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, other.encode_ordinary(t or ""))).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_pipeline_of_no_rows(spark, tables):
    assert corpus_pipeline.run(spark, tables([], items=0)).count() == 0
