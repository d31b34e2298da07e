"""Operator 10: toxicity by weak supervision.

1. Voters that no label takes part in: lexicons of insults in four languages; patterns
   of address (an insult soon after a second person), capitals, exclamation marks,
   disguised spelling, and two or more different insults; and two that vote for clean, when
   every insult is negated, and when there is no cue at all. Four more voters are lexicons
   mined from at most SAMPLE labelled rows outside the held-out fold: words, and their
   beginnings of each length, much more frequent in toxic documents; two of them make
   a vote.
2. Every document votes; how often each combination of votes occurs (two to the power of
   VOTERS at most) goes to a generative label model: EM estimates the class, each
   voter's accuracy, and the voters' correlations within a class, which lower the weight
   of voters that repeat each other. Labels only tell EM where to start.
3. The model's posteriors are the labels of at most SAMPLE documents outside the held-out
   fold, of whichever labels these have: features (words and beginnings) that are more
   frequent where the posterior says toxic, and a linear classifier over them, come from
   posteriors alone. A map scores every document by that classifier.

Defined results: null and empty texts hold no cue and score as such texts do; texts of any
length are read whole, in pieces; without two classes among the labels the score is their
mean (0 if none); repeated rows get equal scores; an empty table gives no rows; columns but
doc_id and text don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, rows_of, span_hashes, texts, tokens_of
from .quality import drawn, fold, sample_of

SAMPLE = 20_000
BEGINNINGS = (4, 6, 8)
#: Posteriors are counted in parts of so many, so that sums don't depend on their order.
PARTS = 1024

#: Common insults and abuse of each language.
LEXICON = {
    "en": "idiot idiots moron morons stupid loser losers scum trash clown pathetic disgusting worthless dumb imbecile bastard bitch asshole jerk fool cretin freak pig vermin filth garbage shit fuck fucking damn coward liar ugly crap",
    "de": "idiot idioten trottel dummkopf blödmann vollidiot arschloch arsch schwein drecksau abschaum versager loser scheiße scheisse verdammt wichser hurensohn penner spinner dumm dämlich widerlich ekelhaft wertlos erbärmlich missgeburt pack gesindel lügner feigling",
    "fr": "idiot idiote imbécile crétin connard connasse salaud salope ordure merde putain débile abruti minable dégoûtant pathétique bouffon raclure racaille menteur lâche pourriture enfoiré bâtard",
    "es": "idiota imbécil estúpido estúpida tonto gilipollas cabrón puta mierda basura escoria asqueroso patético perdedor payaso inútil cerdo maldito bastardo cretino mentiroso cobarde despreciable canalla",
}
#: Words that speak to someone, and words that negate.
ADDRESS = "you your youre u du dich dir dein deine ihr euch sie tu te toi ton ta vous votre tú ti usted eres vos su"
NEGATION = "not no never isnt arent nicht kein keine nie pas ne jamais aucun no nunca ningún sin"
VOTERS = 15
#: Letters that signs and digits stand for in disguised words.
DISGUISE = bytes.maketrans(b"0134578@$!*", b"oieastbasii")


def hashes_of(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), dtype=np.uint8)
    gaps = np.flatnonzero(data == 32)
    return np.sort(span_hashes(data, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]]), 1))


def among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of the hashes the sorted table has."""
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


class Reading:
    """What the voters and the classifier take from a text, in one pass over its pieces."""

    def __init__(self, text: bytes, sequence: bool = True):
        found, kinds, words, disguised = [], [], [], []
        self.capitals = self.marks = 0
        for buf, starts, ends, capital in tokens_of(text):
            first, size = buf[starts], ends - starts
            letters = ((first >= 97) & (first <= 122)) | (first >= 128)
            s, e = starts[letters], ends[letters]
            h = span_hashes(buf, s, e, 1)
            if sequence:
                words.append(h)
                self.capitals += int((capital & letters).sum())
                self.marks += int(((first == 33) & (size >= 2)).sum())
                touch = starts[1:] == ends[:-1]
                for i in np.flatnonzero(touch[:-1] & touch[1:] & letters[:-2] & letters[2:] & (size[1:-1] <= 2) & np.isin(first[1:-1], np.frombuffer(b"0134578@$!*", dtype=np.uint8))):
                    disguised.append(bytes(buf[starts[i] : ends[i + 2]]).translate(DISGUISE))
            long = e - s >= 3
            found.append(h[long])
            kinds.append(np.zeros(int(long.sum()), dtype=np.int8))
            s, e = s[long], e[long]
            for k in BEGINNINGS:
                own = s[e - s > k]
                found.append(span_hashes(buf, own, own + k, 1 + k))
                kinds.append(np.full(len(own), k, dtype=np.int8))
        none = np.empty(0, dtype=np.uint64)
        self.h, at = np.unique(np.concatenate(found), return_index=True) if found else (none, np.empty(0, dtype=np.int64))
        self.kinds = np.concatenate(kinds)[at] if found else np.empty(0, dtype=np.int8)
        self.words = np.concatenate(words) if words else none
        self.disguised = [hashes_of(x.decode("utf-8", "replace"))[0] for x in disguised]


def mine(found: DataFrame, least: int = 4, lift: float = 8.0) -> list[tuple[int, int]]:
    """Features, with kinds, of documents doc_id, text, label (in PARTS): all that at least so many toxic documents
    have, and that are so many times more frequent in them. What may come here is bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 16 << 20):
            read = [Reading(t, False) for t in texts(batch.column(1))]
            label = np.repeat(np.array(batch.column(2).to_pylist(), dtype=np.int64), [len(r.h) for r in read])
            h, first, back = np.unique(np.concatenate([r.h for r in read]), return_index=True, return_inverse=True)
            toxic = np.bincount(back, weights=label, minlength=len(h)).astype(np.int64)
            every = np.bincount(back, minlength=len(h)).astype(np.int64)
            kind = np.concatenate([r.kinds for r in read])[first]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(toxic), pa.array(every)], names=["h", "kind", "toxic", "docs"])

    counts = found.mapInArrow(run, "h long, kind int, toxic long, docs long").groupBy("h").agg(F.max("kind").alias("kind"), (F.sum("toxic") / PARTS).alias("toxic"), F.sum("docs").alias("docs"))
    sizes = found.agg(F.sum("label"), F.count("*")).first()
    toxic = (sizes[0] or 0) / PARTS
    clean = sizes[1] - toxic
    rate = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("docs") - F.col("toxic") + 0.5) / (clean + 1))
    return sorted((r.h, r.kind) for r in counts.where((F.col("toxic") >= least) & (rate >= lift)).select("h", "kind").collect())


class Features:
    """A sorted list of features, and which of them a text has."""

    def __init__(self, mined: list[tuple[int, int]]):
        h = np.array([m[0] for m in mined], dtype=np.int64).view(np.uint64)
        order = np.argsort(h)
        self.h, self.kind = h[order], np.array([m[1] for m in mined], dtype=np.int64)[order]

    def hits(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h) or not len(h):
            return np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(h, self.h), len(h) - 1)
        return np.flatnonzero(h[at] == self.h)


class Voters:
    """The fixed voters and those over mined features."""

    def __init__(self, mined: list[tuple[int, int]]):
        self.mined = Features(mined)
        self.lexicons = [hashes_of(words) for words in LEXICON.values()]
        self.every = np.unique(np.concatenate(self.lexicons))
        self.address, self.negation = hashes_of(ADDRESS), hashes_of(NEGATION)

    def votes(self, text: bytes) -> str:
        """One character a voter: 1 toxic, 0 abstains, - clean."""
        read = Reading(text)
        votes = ["0"] * VOTERS
        at = np.flatnonzero(among(read.words, self.every)) if len(read.words) else np.empty(0, dtype=np.int64)
        cues = np.unique(read.words[at])
        kinds = self.mined.kind[self.mined.hits(read.h)]
        if len(at):
            for i, own in enumerate(self.lexicons):
                if among(cues, own).any():
                    votes[i] = "1"
            before = lambda table, n: np.subtract(*(np.concatenate([[0], np.cumsum(among(read.words, table))])[x] for x in (at, np.maximum(at - n, 0)))) > 0
            if before(self.address, 4).any():
                votes[4] = "1"
            if before(self.negation, 2).all():
                votes[14] = "-"
        if read.capitals >= 3 and read.capitals * 4 >= len(read.words):
            votes[5] = "1"
        if read.marks >= 2:
            votes[6] = "1"
        if any(among(np.array([h], dtype=np.uint64), self.every)[0] for h in read.disguised):
            votes[7] = "1"
        if len(cues) >= 2:
            votes[8] = "1"
        for i, kind in enumerate((0, *BEGINNINGS)):
            if (kinds == kind).sum() >= 2:
                votes[9 + i] = "1"
        if not len(at) and not len(kinds):
            votes[13] = "-"
        return "".join(votes)


class LabelModel:
    """Accuracies and correlations of voters, by EM over how often each combination of votes occurs."""

    def __init__(self, patterns: dict[str, float], prior: float, known: dict[str, tuple[float, float]], rounds: int = 20):
        """known: for combinations among labelled rows, how many are clean and toxic; EM starts there, and from the
        votes where no label says more."""
        self.keys = sorted(patterns)
        v = np.array([[{"-": 0, "0": 1, "1": 2}[c] for c in k] for k in self.keys]).reshape(len(self.keys), VOTERS)
        n = np.array([patterns[k] for k in self.keys])
        seen = np.array([known.get(k, (0.0, 0.0)) for k in self.keys]).reshape(len(self.keys), 2)
        hot = np.eye(3)[v]  # combinations x voters x votes
        self.weight = np.ones(VOTERS)
        self.prior = min(max(prior, 1e-3), 1 - 1e-3)
        start = 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + (v - 1.0).sum(axis=1))))
        post = (seen[:, 1] + start) / (seen.sum(axis=1) + 1)
        for step in range(rounds):
            mass = np.stack([n * (1 - post), n * post], axis=1)
            total = mass.sum(axis=0) + 1e-9
            self.table = (np.einsum("pc,pvk->cvk", mass, hot) + 0.5) / (total[:, None, None] + 1.5)
            self.prior = float(np.clip(total[1] / total.sum(), 1e-3, 1 - 1e-3))
            if step >= 2:
                value = v - 1.0
                corr = np.zeros((VOTERS, VOTERS))
                for c in (0, 1):
                    mean = (mass[:, c] @ value) / total[c]
                    off = value - mean
                    cov = (off * mass[:, c : c + 1]).T @ off / total[c]
                    dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                    corr += 0.5 * np.where(dev[:, None] * dev[None] > 1e-6, cov / (dev[:, None] * dev[None]), 0)
                self.correlations = corr
                self.weight = 1 / (1 + np.maximum(corr - np.eye(VOTERS), 0).clip(0, 1).sum(axis=1))
            ratio = np.log(self.table[1] / self.table[0])
            logit = np.log(self.prior / (1 - self.prior)) + np.take_along_axis(ratio, v.T, axis=1).T @ self.weight
            post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        self.logit = dict(zip(self.keys, logit.tolist()))
        self.accuracies = self.table[1, :, 2] * self.prior / np.maximum(self.table[1, :, 2] * self.prior + self.table[0, :, 2] * (1 - self.prior), 1e-12)

    def posterior(self, votes: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit[votes], -30, 30))))


def fit_linear(rows: list[np.ndarray], y: np.ndarray, size: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression over which cues occur, on soft labels, by full gradient steps."""
    at, row = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b, mw, mb = np.zeros(size), 0.0, np.zeros(size), 0.0
    scale = np.maximum(np.bincount(at, minlength=size), 1.0)
    for _ in range(rounds):
        z = b + np.bincount(row, weights=w[at], minlength=len(rows))
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        mw = 0.9 * mw - 0.2 * (np.bincount(at, weights=d[row], minlength=size) / scale + 0.002 * w)
        mb = 0.9 * mb - 0.2 * d.mean()
        w, b = w + mw, b + mb
    return w, float(b)


def voted(docs: DataFrame, voters, *keep: str) -> DataFrame:
    """The votes of each row of docs (its text, and the columns to keep)."""
    schema = docs.select(*keep).schema.add("votes", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = voters.value
        for batch in rows_of(batches):
            votes = pa.array([own.votes(t) for t in texts(batch.column(0))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], votes], names=[*keep, "votes"])

    return docs.select("text", *keep).mapInArrow(run, schema)


def label_model(docs: DataFrame, labelled: DataFrame, voters) -> LabelModel | None:
    """The label model of all documents' votes; labelled (doc_id, text, label) tells it where to start. None without two classes."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = voters.value, Counter()
        for batch in rows_of(batches):
            seen.update(own.votes(t) for t in texts(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])

    rows = voted(labelled, voters, "label").groupBy("votes").agg(F.sum(F.lit(PARTS) - F.col("label")).alias("clean"), F.sum("label").alias("toxic")).collect()
    known = {r.votes: (r.clean / PARTS, r.toxic / PARTS) for r in rows}
    clean, toxic = (sum(k[i] for k in known.values()) for i in (0, 1))
    if not clean or not toxic:
        return None
    patterns = {r.votes: float(r.n) for r in docs.select("text").mapInArrow(tally, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    return LabelModel(patterns, toxic / (clean + toxic), known)


def classifier(sample: DataFrame, voters, model: LabelModel) -> tuple[Features, np.ndarray, float]:
    """Features, weights and bias, from the posteriors of the sampled documents (doc_id, text) alone."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = voters.value
        for batch in rows_of(batches):
            label = [round(PARTS * model.posterior(v)) if (v := own.votes(t)) in model.logit else 0 for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label, pa.int32())], names=["doc_id", "text", "label"])

    soft = materialise(sample.select("doc_id", "text").mapInArrow(judged, "doc_id long, text string, label int"))
    features = Features(mine(soft))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [features.hits(Reading(t, False).h).astype(np.int32) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "hits"])

    rows = soft.mapInArrow(hits, "doc_id long, label int, hits array<int>").groupBy("doc_id").agg(F.min(F.struct("hits", "label")).alias("x")).orderBy("doc_id").select("x.*").collect()  # a row for each sampled id
    w, b = fit_linear([np.array(r.hits, dtype=np.int64) for r in rows], np.array([r.label / PARTS for r in rows]), len(features.h))
    return features, w, b


def toxicity_scores(docs: DataFrame, labels: DataFrame, of: int = 5, held: int = 0, threshold: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    sc = docs.sparkSession.sparkContext
    gold = sample_of(labels, "toxic", of, held, most).select("doc_id", (F.col("label") * PARTS).cast("int").alias("label"))
    document = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labelled = materialise(document.join(F.broadcast(gold), "doc_id").select("doc_id", "text", "label"))
    voters = sc.broadcast(Voters(mine(labelled)))
    model = label_model(document, labelled, voters)
    if model is None:
        mean = labelled.agg(F.avg("label")).first()[0]
        shared, constant = sc.broadcast((Features([]), np.zeros(0), 0.0)), (mean or 0.0) / PARTS
    else:
        ids = drawn(document.where(F.col("doc_id").isNotNull() & (fold(of) != held)).select("doc_id").distinct(), most)
        shared, constant = sc.broadcast(classifier(document.join(F.broadcast(ids), "doc_id"), voters, model)), None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w, b = shared.value
        for batch in rows_of(batches):
            z = np.array([b + w[features.hits(Reading(t, False).h)].sum() if constant is None else 0.0 for t in texts(batch.column(1))])
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if constant is None else np.full(len(z), constant)
            ids = batch.column(0).to_pylist()
            out = [None if i is None else zlib.crc32(str(i).encode()) % of == held for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return document.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
