"""The ten operators against brute force on small tables, with the awkward rows in each."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from blockloom.llm import bytebpe, common, decontaminate, licenses, linededup, ngramjoin, quality, queries, spotsigs, tokencount, toxicity, warc
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc_hash string"
LONG = "wort und the of " * 20_000


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None, "own") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.text) for r in rows]


ODD = [None, "", " ", "\n\n", "a", "  two  spaces\t\n end ", "é😀中文 ▁mark <s> <|endoftext|>", "x\x00y\x1cz", "IT'S it's 12 345.", LONG]


# 1


def test_byte_bpe_is_as_tiktoken(spark, corpus):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + [t for _, t in corpus]
    got = {r.doc_id: r for r in bytebpe.round_trip(docs_of(spark, texts), path, P.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = other.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    own = bytebpe.codec(path, P.PATTERN)
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(" ▁ab\n\té中😀 's12-_.\x1c\xa0") for _ in range(rng.randint(0, 14)))
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text) and own.decode(ids) == text and len(own.offsets(text)) == len(ids)
    ids = own.encode("😀")
    assert len(ids) > 1 and own.decode(ids[:1]) == "�" and set(own.offsets("a😀")[1:]) == {(1, 2)}
    coded = bytebpe.encode(docs_of(spark, ["a b", None]), path, P.PATTERN, offsets=True)
    assert {r.doc_id: r.text for r in bytebpe.decode(coded, path, P.PATTERN).collect()} == {0: "a b", 1: ""}
    assert bytebpe.round_trip(docs_of(spark, []), path, P.PATTERN).count() == 0


# 2


def spots_in_python(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    if not words:
        return set()
    content = [w for w in words if w not in spotsigs.ANCHORS]
    out, seen = {("", *content[:2])}, 0
    for w in words:
        if w in spotsigs.ANCHORS:
            out.add((w, *content[seen : seen + 2]))
        else:
            seen += 1
    return out


def test_spotsigs(spark, corpus):
    texts = [None, "", "a", "the the of", "One two the three four of five. The six!"] + [t for _, t in corpus]
    ids = list(range(len(texts)))
    got = {r.doc_id: r for r in spotsigs.with_edits(docs_of(spark, texts, ids)).collect()}
    assert len(got) == len(ids)
    for i in ids:
        text, then = texts[i] or "", texts[i - 1 if i else len(ids) - 1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + then[:k]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        sets = [spots_in_python(x) for x in (text, edited, then)]
        assert len(got[i].fingerprint) == 8 * len(sets[0]) and len(got[i].edited_fingerprint) == 8 * len(sets[1])
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert got[i].near_edited == pytest.approx(like(sets[0], sets[1])) and got[i].near_next == pytest.approx(like(sets[0], sets[2]))
    one = spotsigs.with_edits(docs_of(spark, ["the only one"], [5])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert spotsigs.with_edits(docs_of(spark, [])).count() == 0
    twice = spotsigs.with_edits(docs_of(spark, ["b", "a", "c", "d"], [1, 1, None, 7])).collect()
    assert len(twice) == 4 and "Python" not in spotsigs.with_edits(docs_of(spark, ["x"]))._jdf.queryExecution().logical().toString()


def test_spotsigs_join(spark, corpus):
    rows = corpus[:120]
    got = {(r.a, r.b) for r in spotsigs.similar(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]), 0.6).collect()}
    sets: dict = {}
    for i, t in rows:
        s = frozenset(spots_in_python(t))
        sets[s] = min(i, sets.get(s, i))
    want = {(min(a, b), max(a, b)) for x, a in sets.items() for y, b in sets.items() if a < b and x and y and len(x & y) / len(x | y) >= 0.6}
    assert got == want


def test_spotsigs_members(spark):
    text = "the one two of three four and five six to seven eight in nine ten is eleven twelve"
    texts = [text, text.upper(), text + " on", text, text + " on", None]
    docs = docs_of(spark, texts, [4, 4, 4, None, None, 9])
    pairs = spotsigs.similar(docs, 0.6).collect()
    assert len(pairs) == 1 and (pairs[0].a, pairs[0].b) == (4, 4)
    of = {}
    for r in spotsigs.members(docs).collect():
        of.setdefault(r.set_key, []).append(r.doc_id)
    assert sorted(len(v) for v in of.values()) == [2, 3] and {pairs[0].a_key, pairs[0].b_key} == set(of)
    none = spotsigs.similar(docs_of(spark, texts[:3], [None, None, None]), 0.6).collect()
    assert [(r.a, r.b) for r in none] == [(None, None)]


# 3


def shingle_set(text):
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute_classes(texts):
    """For each text: the smallest place in its group, and its number of links to other texts."""
    distinct = list(dict.fromkeys(t or "" for t in texts))
    sets = [shingle_set(t) for t in distinct]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in range(len(distinct)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    at = {t: i for i, t in enumerate(distinct)}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(find(at[t or ""]), i)
    return [(first[find(at[t or ""])], links[at[t or ""]]) for t in texts]


def near_copies(n, words=60, seed=4):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = f"z{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_ngram_join(spark, corpus, monkeypatch):
    texts = [None, "", "!!", "one two", "One, two!", *near_copies(60), LONG, LONG + "x", *[t for _, t in corpus]]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    assert ngramjoin.classes(docs_of(spark, [])).count() == 0
    kept = ngramjoin.one_of_each(docs_of(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in got.values()}) and kept.columns == docs_of(spark, []).columns
    again = ngramjoin.one_of_each(docs_of(spark, ["a b c", "a b c", "d"], [1, 1, None])).collect()
    assert sorted((r.doc_id or -1, r.text) for r in again) == [(-1, "d"), (1, "a b c")]


def test_ngram_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 16)
    texts = near_copies(100, seed=9)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_ngram_join_deals_sets_straight_to_units(spark, monkeypatch):
    """The sets of shingles, its widest rows, are not written down between the second scan and the units."""
    written = []
    monkeypatch.setattr(ngramjoin, "materialise", lambda df: written.append(df.columns) or common.materialise(df))
    texts = near_copies(4)
    got = {r.doc_id: r.class_id for r in ngramjoin.classes(docs_of(spark, texts)).collect()}
    assert len(set(got.values())) < len(texts) and len(written) > 3
    assert not [x for x in written if "items" in x]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i - 1) for i in range(1, 40)] + [(rng.randint(60, 99), rng.randint(50, 59)) for _ in range(60)]
    got = {r.a: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for e in edges for x in e if find(x) != x}
    assert got == want


# 4


def test_warc(spark):
    html = ["<p>one</p>", "<p>one</p>", None, "", "<b>é</b>", "x" * 3_000_000, "<p>one</p>", "WARC/1.1\r\n\r\n"]
    ids = [1, 7, 3, 4, 5, 6, None, 8]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h, "extra") for i, h in zip(ids, html)], "page_id long, url string, html string, digest string")
    folder = common.shared_dir(spark)
    manifest = warc.write(pages, folder)
    for split in (64, 1000, 8 << 20):
        got = sorted(warc.read(spark, folder, manifest, split).collect(), key=lambda r: str(r.page_id))
        assert len(got) == len(ids)
        for r in got:
            data = (html[ids.index(r.page_id)] or "").encode()
            equal = [i for i, h in zip(ids, html) if (h or "").encode() == data and i is not None]
            assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == max(equal) else ("revisit", max(equal)))
    small = warc.round_trip(pages, least_bytes=100).collect()
    assert all(r.record_type == "response" for r in small)
    assert warc.round_trip(pages.limit(0)).count() == 0


def packed(*records):
    return zlib.compress(b"".join(records), 6, 31)


def plain_record(head, body):
    return head + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_warc_headers_of_any_length(spark):
    rows = [(i, "http://h/" + "".join(random.Random(i).choices("abcdef0123456789", k=n)), f"<p>{i}</p>") for i, n in enumerate([200_000] * 12 + [3_000_000] * 2 + [5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = common.shared_dir(spark)
    manifest = warc.write(pages, folder)
    for split in (5000, 8 << 20):
        got = warc.complete(warc.read(spark, folder, manifest, split), manifest).collect()
        assert sorted((r.page_id, r.url) for r in got) == [(i, u) for i, u, _ in rows]
    with pytest.raises(ValueError, match="written"):
        warc.complete(warc.read(spark, folder, manifest).where("page_id > 0"), manifest)


def test_warc_members_of_others():
    info = plain_record(b"WARC/1.0\r\nWARC-Type: warcinfo\r\ncontent-length:5", b"hello")
    two = plain_record(b"WARC/1.1\r\nwarc-type:response\r\nContent-Type: application/http; msgtype=response\r\nX-Long: a\r\n b\r\nCONTENT-LENGTH: 24", b"HTTP/1.1 200 OK\r\n\r\n<p/>x")
    data = packed(info, two, info) + packed(two) + packed(info)
    for step in (7, 64, 1 << 20):
        found = [r for at in range(0, len(data), step) for r in warc.scan(__import__("io").BytesIO(data), at, at + step)]
        assert [r["size"] for r in found] == [5, 5, 5, 5, 5] and found[1]["x-long"] == "a b"
        assert found[1]["sha1"] == base64.b32encode(hashlib.sha1(b"<p/>x").digest()).decode()
    io = __import__("io")
    for broken in (packed(info) + b"junk" + packed(two), packed(info)[:-9], packed(info) + packed(b"WARC/1.0\r\nno: end"), packed(info) + packed(b"WARC/1.0\r\nno: length\r\n\r\n"), packed(info[:-6])):
        with pytest.raises(ValueError):
            list(warc.scan(io.BytesIO(broken), 0, len(broken)))
    assert list(warc.scan(io.BytesIO(packed(info)), 1, 99)) == []


# 5


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def bound(n):
    return n // 20 if n >= 40 else int(n >= 8)


def brute_lines(rows):
    """Line by line: each that goes, with the lines that stay before it and are within the bound, and their edits."""
    kept, gone = [], {}
    for i, k, x in [(i, k, x.split()) for i, t in sorted(rows) for k, x in linededup.lines_of(t or "")]:
        near = {}
        for j, m, v in kept:
            most = bound(min(len(x), len(v)))
            if v == x:
                near[j, m] = 0
            elif most and abs(len(v) - len(x)) <= most and len(set(x) & set(v)) >= len(set(x)) - most and (edits := word_distance(v, x)) <= most:
                near[j, m] = edits
        if near:
            gone[i, k] = near
        else:
            kept.append((i, k, x))
    return gone


def brute_heads(rows):
    """For each line that goes: the line it goes for, which has no partner, and their edits."""
    first, at, partner = [], {}, {}
    lines = [(i, k, tuple(x.split())) for i, t in sorted(rows) for k, x in linededup.lines_of(t or "")]
    for i, k, x in lines:
        if x not in at:
            near = []
            for j, m, v in first:
                most = bound(min(len(x), len(v)))
                if most and abs(len(v) - len(x)) <= most and len(set(x) & set(v)) >= len(set(x)) - most and (edits := word_distance(v, x)) <= most:
                    near.append((edits > 1, j, m, edits))
            partner[x] = min(near, default=None)
            first.append((i, k, x))
            at[x] = (i, k)
    text, gone = {(i, k): x for i, k, x in lines}, {}
    for i, k, x in lines:
        if partner[x] and not partner[text[partner[x][1:3]]]:
            gone[i, k] = partner[x][1:]
        elif at[x] != (i, k):
            gone[i, k] = (*at[x], 0)
    return gone


def check_heads(spark, rows):
    found = linededup.dropped_lines(docs_of(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert {(r.doc_id, r.line): (r.kept_doc_id, r.kept_line, r.edits) for r in found} == brute_heads(rows)
    return found


def check_lines(spark, rows):
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    found = linededup.dropped_lines(docs, exhaustive=True).collect()
    want = brute_lines(rows)
    assert {(r.doc_id, r.line) for r in found} == set(want)
    for r in found:  # the line named stays, stands before, and is so many edits away
        assert want[r.doc_id, r.line][r.kept_doc_id, r.kept_line] == r.edits
    return docs, found


BASE = "one two three four five six seven eight nine ten".split()


def test_line_dedup(spark, corpus):
    w = BASE
    made = [" ".join(w), " ".join(w).upper() + "!", " ".join(w[:-1]), " ".join(w[1:]), " ".join([*w[:4], "x", *w[4:]]), " ".join([*w[:9], "y"]), " ".join(["z", *w[1:]]), " ".join(w[::-1]), " ".join(w[:3]) + "\n" + " ".join(w[:3]), "a b", None, ""]
    made += [" ".join([*w[:5], f"n{i}", *w[6:]]) for i in range(12)] + [LONG, LONG + "\nq"]
    rows = list(enumerate(made)) + [(i + 1000, t) for i, t in corpus[:90]]
    check_lines(spark, rows)
    found, docs = check_heads(spark, rows), docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    got = {(r.doc_id, r.line) for r in found}
    kept = {r.doc_id: r for r in linededup.without_repeats(docs).collect()}
    for i, t in rows:
        rest = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in got)
        if any(d == i for d, _ in got):
            assert (i in kept) == bool(re.search(r"[^\W_]", rest)) and (i not in kept or (kept[i].text == rest and kept[i].n_chars == len(rest)))
        else:
            assert kept[i].text == t
    assert linededup.dropped_lines(docs_of(spark, [])).count() == 0
    assert linededup.without_repeats(docs_of(spark, ["same line here", "same line here"], [3, 3])).count() == 2


def test_line_dedup_of_chains(spark):
    """Lines of which each is one word from the one before: of 1, 2, 3, 4 the first and the third stay."""
    chain = [" ".join([*(f"n{j}" for j in range(i)), *BASE[i:]]) for i in range(9)]
    made = [*chain, chain[3], chain[2], chain[2] + "\n" + chain[5], *chain[::-1]]
    far = [[f"w{i}" for i in range(60)]]
    for i in range(8):  # three words a step: the bound of 60 words is three
        far.append([f"x{i}" if at in (i * 7, i * 7 + 1, i * 7 + 2) else x for at, x in enumerate(far[-1])])
    order = random.Random(3).sample(range(len(far)), len(far))
    made += [" ".join(x) for x in far] + [" ".join(far[i]).replace("w", "u") for i in order]
    _, found = check_lines(spark, list(enumerate(made)))
    assert {(r.doc_id, r.line) for r in found if r.doc_id < 9} == {(1, 0), (3, 0), (5, 0), (7, 0)}
    found = check_heads(spark, list(enumerate(made)))
    gone = {(r.doc_id, r.line) for r in found}
    assert not {(r.kept_doc_id, r.kept_line) for r in found} & gone


def test_line_dedup_classes_of_lengths(spark):
    """One edit at any place of lines of any length, at the edges of the classes of lengths too."""
    rows = []
    for n in (7, 8, 9, 11, 12, 13, 17, 18, 19, 26, 27, 28, 38, 39):
        line = [f"v{n}x{i}" for i in range(n)]
        for at in (0, n // 3, n // 2, n - 1):
            own = [f"{x}y{at}" for x in line]
            for other in (own[:at] + own[at + 1 :], own[:at] + ["q"] + own[at + 1 :], own[:at] + ["q"] + own[at:]):
                pair = [" ".join(own), " ".join(other)]
                rows += [(len(rows) + k, "\n".join(pair[:: 1 - 2 * (len(rows) % 2)])) for k in range(1)]
    check_lines(spark, rows)


def test_line_dedup_of_short_lines(spark):
    texts = ["a b\nx", "A, b!\n...\ny", "x", "...\n\n \nnot here", "中文没有空格\na b c", "中文没有空格。", "1\n1", "a"]
    docs = docs_of(spark, texts)
    got = {(r.doc_id, r.line): (r.kept_doc_id, r.kept_line, r.edits) for r in linededup.dropped_lines(docs).collect()}
    assert got == {(1, 0): (0, 0, 0), (2, 0): (0, 1, 0), (5, 0): (4, 0, 0), (6, 1): (6, 0, 0)}
    kept = {r.doc_id: r.text for r in linededup.without_repeats(docs).collect()}
    assert kept == {0: texts[0], 1: "...\ny", 3: texts[3], 4: texts[4], 6: "1", 7: "a"}


def test_line_dedup_bound_grows(spark, corpus, monkeypatch):
    rng = random.Random(7)
    made = []
    for n in (39, 40, 57, 60, 133):
        base = [f"w{rng.randint(0, 300)}" for _ in range(n)]
        made.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 7, 8):
            own = list(base)
            for at in sorted(rng.sample(range(len(own)), edits), reverse=True):
                own[at : at + 1] = rng.choice([[], ["x", own[at]], [f"z{rng.randint(0, 99)}"]])
            made.append(" ".join(own))
    # a passage that many lines share, and near copies that differ among themselves
    passage = [f"p{i}" for i in range(20)]
    made += [" ".join([*(f"a{rng.randint(0, 900)}" for _ in range(25)), *passage]) for _ in range(20)]
    base = [f"c{i}" for i in range(60)]
    made += [" ".join(f"d{rng.randint(0, 99)}" if i in at else x for i, x in enumerate(base)) for at in (rng.sample(range(60), rng.randint(1, 3)) for _ in range(40))]
    rng.shuffle(made)
    made += [LONG, LONG, LONG[:8000], LONG[:8000] + " q r s", "\n".join(made[:5])]
    rows = list(enumerate(made)) + [(i + 1000, t) for i, t in corpus[:60]]
    for block, try_ in ((linededup.BLOCK, linededup.TRY), (8, 1)):
        monkeypatch.setattr(linededup, "BLOCK", block)
        monkeypatch.setattr(linededup, "TRY", try_)
        _, found = check_lines(spark, rows)
    assert any(r.edits > 1 for r in found)


@pytest.mark.parametrize("at_once", [0, linededup.AT_ONCE])
def test_line_dedup_leaves_no_line_near_one_that_stays(spark, tmp_path, monkeypatch, at_once):
    """The query and the pipeline's stage decide chains to their ends, in rounds and in one task alike."""
    monkeypatch.setattr(linededup, "AT_ONCE", at_once)
    chain = [" ".join([*(f"n{j}" for j in range(i)), *BASE[i:]]) for i in range(6)]
    near = " ".join([*chain[2].split()[:9], "other"])  # its first partner goes, its second one stays
    far = [[f"w{i}" for i in range(60)]]
    for i in range(5):
        far.append([f"x{i}" if at in (i * 7, i * 7 + 1, i * 7 + 2) else x for at, x in enumerate(far[-1])])
    rows = list(enumerate([*chain, near, *(" ".join(x) for x in far), "\n".join(chain[::-1]), *(" ".join(x).replace("w", "u") for x in far[::-1])]))
    docs = docs_of(spark, [t for _, t in rows])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_lines(rows)
    found = queries.op5_line_dedup(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.line) for r in found} == set(want)
    assert all(want[r.doc_id, r.line][r.kept_doc_id, r.kept_line] == r.edits for r in found)
    assert set(want) > set(brute_heads(rows))
    kept = {r.doc_id: r.text for r in linededup.without_repeats(docs).collect()}
    assert kept == {i: x for i, t in rows if (x := "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in want))}


def test_columns_with_clashing_names(spark):
    """Helper columns never meet the caller's, whatever these are called; values come through."""
    more = ["own_hash", "gone", "gone_id", "gone_hash", "keep_id", "keep_hash", "doc_hash", "GONE_", "x", "key", "rank", "line", "h1", "score", "n"]
    rows = [(i, t, None, "s", None, *(f"{c}{i}" for c in more)) for i, t in enumerate(["a b c d\nsame line", "same line\nother text here", None, "a b c d e f", "a b c d e f", ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in more))
    bench = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    outs = [linededup.without_repeats(docs), ngramjoin.one_of_each(docs), decontaminate.clean(docs, bench), quality.accepted(docs, labels, threshold=0.0)]
    for out in outs:
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in more)
    for f in (spotsigs.with_edits, licenses.scan, linededup.dropped_lines, ngramjoin.classes):
        f(docs).collect()


# 6


def test_decontamination(spark, corpus):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    t = items[0][1]
    changed = list(t)
    for i in range(5, len(changed), 40):
        changed[i] = "#" if changed[i] == "q" else "q"
    far = list(t)
    for i in range(0, len(far), 5):
        far[i] = "q"
    made = [None, "", t, "before " + t.upper() + " after", "xx " + "".join(changed) + " yy", "xx " + "".join(far), LONG + t + LONG]
    rows = list(enumerate(made)) + [(i + 1000, x) for i, x in corpus]
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, "zzqx")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(docs_of(spark, [x for _, x in rows], [i for i, _ in rows]), bench).collect()}
    for i in (2, 3, 4, 6):
        assert (i, items[0][0]) in got
    assert (5, items[0][0]) not in got
    exact = {(i, k) for i, x in rows for k, y in items if x and common.normal(y) in common.normal(x)}
    assert {k for k, e in got.items() if e == 0} == exact
    for i, k in set(got) - exact:  # each find holds by plain dynamic programming
        a, b = common.normal(dict(items)[k]), common.normal(dict(rows)[i])
        row = [0] * (len(b) + 1)
        for n, x in enumerate(a, 1):
            last, row[0] = row[0], n
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert min(row) == got[i, k] <= int(len(a) * 0.08)
    clean = decontaminate.clean(docs_of(spark, made), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [0, 1, 5]
    assert decontaminate.contaminated(docs_of(spark, made), bench.limit(0)).count() == 0


def test_alignment_is_least():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = rng.integers(0, 3, rng.integers(1, 12)), rng.integers(0, 3, rng.integers(1, 16))
        row = [0] * (len(b) + 1)
        for n, x in enumerate(a, 1):
            last, row[0] = row[0], n
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        got = decontaminate.align(a, b, 99)
        assert got[0] == min(row) and 0 <= got[1] <= got[2] <= len(b)


def least_edits(item, texts):
    """For each text the least edits of the item against any part of it, by plain dynamic programming over all its places
    (texts stand one after another, apart by more signs that no item has than the bound allows edits)."""
    gap = np.zeros(int(len(item) * 0.08) + 1, dtype=np.uint32)
    parts = [common.codes(common.normal(t or "")) for t in texts]
    joined = np.concatenate([x for part in parts for x in (part, gap)])
    end = np.cumsum([len(x) + len(gap) for x in parts]) - len(gap)
    place, row = np.arange(len(joined) + 1), np.zeros(len(joined) + 1, dtype=np.int64)
    for n, c in enumerate(common.codes(item), 1):
        new = row + 1
        new[0] = n
        new[1:] = np.minimum(new[1:], row[:-1] + (joined != c))
        row = np.minimum.accumulate(new - place) + place
    return [int(row[e - len(x) : e + 1].min()) for e, x in zip(end, parts)]


def with_edits(rng, text, edits):
    own = list(text)
    for at in sorted(rng.sample(range(len(own)), edits), reverse=True):
        own[at : at + 1] = rng.choice([[], ["q", own[at]], ["z"], ["7"]])
    return "".join(own)


def test_decontamination_finds_all_within_the_bound(spark, corpus):
    """Every pair within the bound is found with its least edits, and no other, with edits on both sides of the bound."""
    rng = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(8).collect()]
    items += [(900, "short one"), (901, "zq"), (902, "a b " * 60 + "end"), (903, items[0][1])]
    texts = [t for _, t in corpus[:25]]
    for _, t in items:
        n = len(common.normal(t))
        for edits in {0, 1, n // 25, int(n * 0.08) - 1, int(n * 0.08), int(n * 0.08) + 1, n // 10}:
            if 0 <= edits <= n:
                texts.append(f"w{len(texts)} x " + with_edits(rng, common.normal(t), edits) + f" y{len(texts)}")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    want = {}
    for k, t in items:
        item = common.normal(t)
        want |= {(i, k): e for i, e in enumerate(least_edits(item, texts)) if e <= int(len(item) * 0.08)}
    assert got == want and sum(e > 0 for e in want.values()) > 20


# 7 and 10


def held_out(spark, query, column, of, rest, threshold):
    labels = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", column).collect()}
    rows = query(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    pairs = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    right = [sum(p == y for p, y in pairs if y == k) / max(1, sum(y == k for _, y in pairs)) for k in (0, 1)]
    print(query.__name__, "held-out accuracy by class", right, len(pairs))
    return right


def test_quality(spark):
    assert min(held_out(spark, queries.op7_quality, "quality", 4, 2, 0.7)) > 0.9


def test_toxicity(spark):
    assert min(held_out(spark, queries.op10_toxicity, "toxic", 5, 0, 0.5)) > 0.85


@pytest.mark.parametrize("score, column", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_scores_of_odd_rows(spark, score, column):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "y"), (None, 1, "z"), (3, None, "t"), (4, 7, "u")], f"doc_id long, {column} int, text string")
    docs = docs_of(spark, [*ODD, "again", "again"], [*range(len(ODD)), None, None])
    rows = score(docs, labels).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert score(docs_of(spark, []), labels).count() == 0 and len(score(docs, labels.limit(0)).collect()) == len(rows)


def test_label_model_knows_copies():
    """A voter that repeats another adds little; accuracies are those of the votes."""
    rng = np.random.default_rng(1)
    seen = Counter()
    for _ in range(4000):
        y = rng.random() < 0.3
        a, b, c = ("1" if rng.random() < (p if y else q) else "0" for p, q in ((0.9, 0.01), (0.8, 0.02), (0.7, 0.01)))
        seen[a + a + b + c + "0" * (toxicity.VOTERS - 5) + ("0" if "1" in a + b + c else "-")] += 1
    model = toxicity.LabelModel({k: float(n) for k, n in seen.items()}, 0.3, {})
    assert model.weight[0] < model.weight[2] and model.weight[0] < model.weight[3] and min(model.accuracies[:4]) > 0.9
    both = "1111" + "0" * (toxicity.VOTERS - 4)
    assert both in model.logit and model.posterior(both) > 0.9 and model.posterior("0" * (toxicity.VOTERS - 1) + "-") < 0.2


def test_voters():
    of = toxicity.Voters([]).votes
    names = {"You are such an idiot!": "en", "Du bist ein Trottel": "de", "espèce de connard": "fr", "eres un payaso": "es"}
    for i, text in enumerate(names):
        assert of(text.encode())[i] == "1" and of(text.encode())[13] == "0"
    assert of(b"You are such an idiot")[4] == "1" and of(b"an idiot spoke")[4] == "0"
    assert of(b"THIS IS LOUD and so on")[5] == "1" and of(b"what!! really!!!")[6] == "1" and of(b"an id1ot here")[7] == "1" and of(b"word1 2word.x")[7] == "0"
    assert of(b"stupid loser")[8] == "1" and of(b"he is not stupid")[14] == "-" and of(b"he is stupid")[14] == "0"
    assert of(b"") == of(b"a plain text") == "0" * 13 + "-0"


def test_toxicity_rests_on_the_label_model(spark, monkeypatch):
    """Insults that no label knows are found; without posteriors nothing is."""
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(300)]
    texts = []
    for i in range(600):
        own = rng.choices(words, k=30)
        if i % 6 == 0:
            own[5:8] = ["you", rng.choice(["stupid", "worthless", "pathetic"]), "grobnik"]
        texts.append(" ".join(own))
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 120)], "doc_id long, toxic int")
    docs = docs_of(spark, [*texts, "a grobnik came", "a loser came"])
    run = lambda: {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    got = run()
    assert all(got[i].predicted == (i % 6 == 0) for i in range(600)) and got[600].score > got[1].score
    # labels may be as wrong as they like for documents; posteriors come from votes
    fitted = toxicity.label_model

    def blind(*args):
        model = fitted(*args)
        model.logit = dict.fromkeys(model.logit, -30.0)
        return model

    monkeypatch.setattr(toxicity, "label_model", blind)
    assert not any(r.predicted for r in run().values())


# 8


def test_licenses(spark, corpus):
    made = [None, "", "All rights reserved.", "text\nLicensed under the Apache License, Version 2.0.\nmore", "this work is licensed under the gnu general public licence", LONG, "the license of the bus driver was checked by the police"]
    rows = list(enumerate(made)) + [(i + 1000, t) for i, t in corpus]
    found = licenses.scan(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]))
    got = {(r.doc_id, r.line): r.family for r in found.collect()}
    kinds = {"Apache-2.0": "Apache", "MIT": "MIT", "GPL-3.0": "General Public License, version 3", "CC-BY-NC": "BY-NC", "all-rights-reserved": "All rights reserved"}
    want = {(i, k): f for i, t in rows for k, x in enumerate((t or "").split("\n")) for f, cue in kinds.items() if cue in x}
    assert {k: f for k, f in got.items() if k in want} == want and not {k for k in got if k[0] == 6}
    assert len(set(got) - set(want)) <= 1


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
ODD_DOCS = [
    "one\n\n" + GPL + "\n\ntwo", "# " + GPL.replace("\n", "\n# "), WARRANTY, "SPDX-License-Identifier: Apache-2.0", "The driver's license and the fishing licence were renewed.",
    "This library is distributed under the GNU Lesser General Public License, version 3.", "Permission was granted to build a bridge.", "All seats are reserved.", "prose\nprose again\nReleased under the MIT License.\nprose", None, "",
]


def test_licenses_of_wrapped_and_whole_texts(spark):
    docs = docs_of(spark, [*ODD_DOCS, ODD_DOCS[0], ODD_DOCS[3]], [*range(len(ODD_DOCS)), None, 3])
    rows = licenses.scan(docs).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.line, r.family) for r in rows)
    assert got == [(-1, 2, "GPL-3.0"), (0, 2, "GPL-3.0"), (1, 0, "GPL-3.0"), (2, 0, "MIT"), (3, 0, "Apache-2.0"), (3, 0, "Apache-2.0"), (5, 0, "LGPL"), (8, 2, "MIT")]
    assert all(0.5 <= r.probability <= 1 and r.overlap >= licenses.CONFIRM for r in rows)
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_the_licence_classifier_decides(spark, monkeypatch):
    """A template alone finds nothing: with another family's training, or none, the same texts get other answers."""
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    known = {k: list(v) for k, v in licenses.NOTICES.items()}
    monkeypatch.setattr(licenses, "NOTICES", {**known, "MIT": ["zzq zzr zzs zzt"], "Apache-2.0": ["zzu zzv zzw zzx"]})
    # the templates still hold both texts
    assert not {r.family for r in licenses.scan(docs_of(spark, texts)).collect()} & {"MIT", "Apache-2.0"}
    # where templates of two families fit equally, the classifier says which
    both = [*licenses.TEMPLATES["MIT"], *licenses.TEMPLATES["Apache-2.0"]]
    monkeypatch.setattr(licenses, "NOTICES", known)
    monkeypatch.setattr(licenses, "TEMPLATES", {**licenses.TEMPLATES, "MIT": both, "Apache-2.0": both})
    assert sorted((r.doc_id, r.family) for r in licenses.scan(docs_of(spark, texts)).collect()) == [(0, "MIT"), (1, "Apache-2.0")]


# 9


def test_token_counts(spark, corpus):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + [t for _, t in corpus]
    for head in (tokencount.HEAD, 5):
        got = {r.doc_id: r for r in tokencount.token_counts(docs_of(spark, texts), path, 4096, head).collect()}
        for i, t in enumerate(texts):
            n = len(other.encode(t or ""))
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    assert tokencount.token_counts(docs_of(spark, []), path).count() == 0
    assert tokencount.token_counts(docs_of(spark, ["a b"] * 3, [1, 1, None]), path).count() == 3


def test_line_variants_emitted():
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["a", "b", "é"]) for _ in range(rng.choice([8, 8, 9, 12, 13]))) for _ in range(300)]
    first = np.array([rng.random() < 0.5 for _ in lines], dtype=np.int64)
    second = np.where(first == 1, [rng.random() < 0.3 for _ in lines], 1)
    key, kind, row = linededup.emitted(lines, first, second)
    of: dict[int, set] = {}
    for k, z, r in zip(key.tolist(), kind.tolist(), row.tolist()):
        of.setdefault(k, set()).add((z, r))
    got = sorted(sorted(x) for x in of.values())
    want: dict[tuple, set] = {}
    for r, text in enumerate(lines):
        w, n = text.split(" "), len(text.split(" "))
        h = max(c for c in linededup.CLASSES if c < n or n == linededup.EDITED == c) // 2 if n in linededup.CLASSES[1:] else max(c for c in linededup.CLASSES if c <= n) // 2
        want.setdefault(tuple(w), set()).add((2, r))
        for i in range(0 if second[r] else h, n if first[r] else n - h):
            left = tuple(w[:i] + w[i + 1 :])
            want.setdefault(("at", i, left), set()).add((0, r))
            want.setdefault(left, set()).add((1, r))
    assert got == sorted(sorted(x) for x in want.values())


def test_workers_let_go_of_what_another_operator_remembers():
    codec = bytebpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    codec.encode("some words to remember")
    list(common.rows_of(iter([]), keeps="bytebpe"))
    assert bytebpe.codec.cache_info().currsize == 1
    list(common.rows_of(iter([])))
    assert bytebpe.codec.cache_info().currsize == 0


def test_units_of_the_same_lines_become_one():
    """Lines that share many kept hashes meet once, whatever their hashes; of a line that came twice only one is left."""
    bag = bytes([2] * linededup.BAG)
    rows = [(key, 0, 0, 0, 64, bag, h1, h1 * 7) for key in (3, 5, 9) for h1 in (11, 12, 12, 13)] + [(12, 0, 0, 0, 64, bag, 11, 77), (12, 0, 0, 0, 64, bag, 12, 84)]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.int64(), pa.int64()))], names=linededup.UNIT)
    got = [(r["key"], r["h1"]) for x in linededup.alike(iter([batch])) for r in x.to_pylist()]
    of = {k: sorted(h for key, h in set(got) if key == k) for k, _ in got}
    assert sorted(of.values()) == [[11, 12], [11, 12, 13]] and len(got) == 3 * 3 + 2


def test_repeated_values(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(-300, 300)]) for _ in range(3000)]
    df = spark.createDataFrame([(x, 2) for x in values], "x long, w long").repartition(5)
    packed = common.repeated(df, lambda batch: (batch.column(0).to_numpy(), batch.column(1).to_numpy()))
    want = {x: 2 * values.count(x) for x in set(values) if values.count(x) > 1}
    assert {r.key: r["size"] for r in common.unpacked(packed).collect()} == want
    assert common.in_bits(np.frombuffer(common.bits_in(packed), dtype=np.int64), np.array(list(want))).all()


def test_word_distance():
    rng = random.Random(11)
    for _ in range(2000):
        w = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        v = [rng.choice("abcd") for _ in range(rng.randint(0, 12))] if rng.random() < 0.5 else [x for x in w if rng.random() < 0.9]
        d = word_distance(w, v)
        assert linededup.within_one(" ".join(w), " ".join(v)) == (d <= 1) or not w or not v
        for most in range(7):
            assert linededup.distance(w, v, most) == (d if d <= most else None)
