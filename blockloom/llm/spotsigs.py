"""Operator 2: SpotSigs fingerprints, with DataFrame functions only.

A spot is an anchor (one of the most common words of four languages, or the
beginning of the text) with the chain of the next LINKS content words after it,
hashed to 32 bits. A text's fingerprint is its sorted set of spots, each in eight
hexadecimal digits; texts are alike as the Jaccard similarity of their sets is
high. Equal texts have equal fingerprints.

similar() is the join: sets are partitioned by their length so that sets of
different partitions that aren't neighbours can't reach the threshold; a pair
meets through the rarest spots of a prefix that any pair over the threshold must
share, is pruned by its lengths, and is compared exactly at last. members() says
which documents share a set. The query itself compares each document with two given
others by likeness(), exactly and without pruning, and doesn't reach the join.

Defined results: a null text is the empty text, with the empty fingerprint (two
empty sets are alike by 1, an empty one and another by 0); a text without anchors
has the one spot of its beginning; texts of any length are taken whole; rows with
equal ids are ordered by their texts; a null id comes last; one document is its
own next one; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

LINKS = 2
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it not of on or she that the their they this to was we were which with you "
    "als auch auf aus bei das dem den der des die ein eine er es für im ist mit nach nicht sich sie sind so und von war zu "
    "au avec ce dans de du elle en est et il la le les ne ou par pas plus pour qui que se son sur un une "
    "al como con del el ella en es esta la las lo los más no o para pero por que se si su un una y"
).split()
ANCHORS = tuple(dict.fromkeys(ANCHORS))


def spots(text: str) -> Column:
    """The sorted set of spots of a column, as array<int>."""
    anchors = ", ".join(f"'{a}'" for a in ANCHORS)
    # each step is bound to a lambda variable, so that it is computed once for each text and not for each word;
    # -1 as the place of an anchor stands for the beginning of the text
    return F.expr(
        f"""
        transform(array(filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> '')), w ->
          if(size(w) = 0, cast(array() as array<int>),
            transform(array(struct(
              filter(w, x -> x not in ({anchors})) as content,
              filter(transform(w, (x, i) -> if(x in ({anchors}), i, null)), i -> i is not null) as place)), s ->
              array_sort(array_distinct(array_append(
                transform(s.place, (p, k) -> hash(w[p], get(s.content, p - k), get(s.content, p - k + 1))),
                hash('', get(s.content, 0), get(s.content, 1)))))
            )[0])
        )[0]
        """
    )


def as_text(spots_column: str) -> Column:
    return F.expr(f"array_join(transform({spots_column}, x -> lpad(lower(hex(x & 4294967295L)), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets, which are intersected unless one is empty."""
    return F.expr(
        f"""
        case when size({a}) = 0 and size({b}) = 0 then 1D
             when size({a}) = 0 or size({b}) = 0 then 0D
             else transform(array(size(array_intersect({a}, {b}))), n -> cast(n as double) / (size({a}) + size({b}) - n))[0] end
        """
    )


def length_partition(size: Column, threshold: float) -> Column:
    """Sets over the threshold lie in the same partition or in neighbouring ones."""
    return F.floor(F.log(size) / F.lit(math.log(1 / threshold)))


def set_key(spots_column: str) -> Column:
    """A name for a set of spots; documents with null or equal ids may hold several sets."""
    return F.sha2(as_text(spots_column).cast("binary"), 256)


def members(docs: DataFrame) -> DataFrame:
    """doc_id and set_key of each row of docs that has spots."""
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spots("coalesce(text, '')").alias("spots"))
    return made.where(F.size("spots") > 0).select("doc_id", set_key("spots").alias("set_key"))


def similar(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of sets of spots that are alike by the threshold or more, each pair once.

    Returns a (the smallest id of a set; null if it has none), b (that of another), jaccard, and the keys of
    both sets, by which members() names all documents that share them.
    """
    sets = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), spots("coalesce(text, '')").alias("spots"))
        .where(F.size("spots") > 0)
        .groupBy("spots")
        .agg(F.min("doc_id").alias("id"))
        .withColumn("key", set_key("spots"))
        .withColumn("n", F.size("spots"))
        .withColumn("part", length_partition(F.col("n"), threshold))
    )
    sets = materialise(sets)
    every = sets.select("key", "n", "part", F.explode("spots").alias("spot"))
    common = materialise(every.groupBy("spot").agg(F.count("*").alias("df")))
    ranked = every.join(common, "spot").groupBy("key", "n", "part").agg(F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("order"))
    # of sets alike by t, the rarest n - ceil(t n) + 1 spots of each share one
    prefix = F.expr(f"slice(order, 1, n - cast(ceil({threshold} * n) as int) + 1)")
    keyed = materialise(ranked.select("key", "n", "part", F.explode(F.transform(prefix, lambda x: x["spot"])).alias("spot")))
    left = keyed.select(F.col("key").alias("ka"), F.col("n").alias("na"), "part", "spot")
    right = keyed.select(F.col("key").alias("kb"), F.col("n").alias("nb"), F.col("part").alias("own"), F.explode(F.expr("array(part, part + 1)")).alias("part"), "spot")
    # b's partition is a's or the one below; pairs within one partition are taken once
    pairs = (
        left.join(right, ["part", "spot"])
        .where((F.col("own") < F.col("part")) | (F.col("ka") < F.col("kb")))
        .where(F.least("na", "nb") >= F.ceil(threshold * F.greatest("na", "nb")))
        .select("ka", "kb").distinct()
    )
    side = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    full = sets.select("key", side.alias("x"), "spots")
    return (
        pairs.join(full.select(F.col("key").alias("ka"), F.col("x").alias("xa"), F.col("spots").alias("sa")), "ka")
        .join(full.select(F.col("key").alias("kb"), F.col("x").alias("xb"), F.col("spots").alias("sb")), "kb")
        .withColumn("jaccard", likeness("sa", "sb"))
        .where(F.col("jaccard") >= threshold)
        .select(F.least("xa", "xb").alias("x"), F.greatest("xa", "xb").alias("y"), "jaccard")
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "jaccard", F.col("x.key").alias("a_key"), F.col("y.key").alias("b_key"))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, spots and fingerprint of each row."""
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spots("coalesce(text, '')").alias("spots"))
    return made.withColumn("fingerprint", as_text("spots"))


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document with its fingerprint, that of its edited text, and its likeness to that and to the next document.

    The next document by descending id is found without one global order: ids
    are cut into ranges (by an approximate quantile, so ranges hold about equally many
    rows), each range is one hash partition, and the first document of each range is
    sent to the range before it too. That is one shuffle of the texts, with at most
    one more row for each range.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * tasks  # several to a task, so that tasks are even
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges).alias("cuts")).first().cuts or []
    cuts = sorted(set(cuts), reverse=True)  # at most as many as ranges
    # the range of an id: how many cuts lie above it; a range holds (next cut, cut]
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    part = F.size(F.filter(F.array([F.lit(c) for c in cuts]), lambda c: c > place)) if cuts else F.lit(0)
    # the first document of each range: the largest id, and of its rows the smallest text
    top = rows.select(part.alias("part"), place.alias("id")).groupBy("part").agg(F.max("id").alias("top")).collect()
    firsts = {r.top: r.part for r in top}
    filled = sorted(firsts.values())
    # the range before each; before the first comes the last
    to = F.lit(None).cast("int")
    if filled:
        before = {p: filled[i - 1] for i, p in enumerate(filled)}
        to = F.try_element_at(F.create_map([F.lit(x) for i, p in firsts.items() for x in (i, before[p])]), place)
    dealt = (
        rows.withColumn("part", part)
        .withColumn("to", to)
        .withColumn("at", F.explode(F.expr("if(to is null, array(struct(part as part, false as halo)), array(struct(part as part, false as halo), struct(to as part, true as halo)))")))
        .select("doc_id", "text", "at.*")
    )
    # a range's own rows first, then the first document of the range after it: the next row is the next document
    dealt = dealt.repartition(tasks, "part").withColumn("spots", spots("text"))
    own = Window.partitionBy("part").orderBy("halo", F.col("doc_id").desc_nulls_last(), "text")
    following = dealt.withColumn("then", F.lead(F.struct("text", "spots")).over(own))
    k = F.floor(F.length("text") / 3).cast("int")
    edited = following.where(~F.col("halo")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.length("text") - k), F.substring("then.text", F.lit(1), k))
    )
    edited = edited.withColumn("edited_spots", spots("edited"))
    return edited.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("spots").alias("fingerprint"),
        as_text("edited_spots").alias("edited_fingerprint"),
        likeness("spots", "edited_spots").alias("near_edited"),
        likeness("spots", "then.spots").alias("near_next"),
    )
