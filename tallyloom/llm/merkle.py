"""Document fingerprints in DataFrame operations only: Merkle trees over paragraphs and sections.

A section is a line; its paragraphs are its sentences, cut at 80 characters where none ends. A leaf is the
hash of a paragraph, a section's hash that of its leaves, the root that of the sections. The fingerprint
writes the tree down: `root|section=leaf.leaf;section=leaf...`. Hashes are of 128 bits up to the root, so equal
roots mean equal texts; a fingerprint may write fewer digits of the hashes below the root. Where roots differ,
sections that differ, place by place, locate the edit, and the share of common leaves is the likeness.

Defined results: a null text is an empty one, with one empty section; two empty texts are alike by 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PARAGRAPH = r"[^.!?]{0,80}[.!?]+|[^.!?]{1,80}"
#: Hexadecimal digits of a whole hash.
DIGITS = 32
#: Buckets that are told apart by looking through their bounds; more are cut evenly between the bounds.
BOUNDS = 512


def hashes(text: Column) -> Column:
    """The hashes of the paragraphs, an array for each section."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.transform(F.regexp_extract_all(line, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.md5(p.cast("binary"))))


def tree(hashed: Column, digits: int = DIGITS) -> Column:
    """The tree over hashes of paragraphs, written down with so many digits of each hash; hashes are of whole ones."""
    cut = (lambda h: h) if digits == DIGITS else (lambda h: F.left(h, F.lit(digits)))
    section = lambda s: cut(F.md5(F.array_join(s, ".").cast("binary")))
    return F.array_join(F.transform(hashed, lambda s: F.concat(section(s), F.lit("="), F.array_join(F.transform(s, cut), "."))), ";")


def fingerprint(text: Column, digits: int = DIGITS) -> Column:
    """The tree of a text, written down."""
    return tree(hashes(text), digits)


def rooted(whole: Column, written: Column | None = None) -> Column:
    """Puts the root, the hash of the whole tree, before the tree that is written down."""
    return F.concat(F.md5(whole.cast("binary")), F.lit("|"), whole if written is None else written)


def leaves(mark: Column) -> Column:
    return F.array_distinct(F.split(F.regexp_replace(F.substring_index(mark, "|", -1), "[0-9a-f]+=", ""), "[.;]", -1))


def likeness(leaves_a: Column, leaves_b: Column, root_a: Column, root_b: Column) -> Column:
    """1 for equal roots, else the common leaves over the larger number of leaves."""
    shared = F.size(F.array_intersect(leaves_a, leaves_b)) / F.greatest(F.size(leaves_a), F.size(leaves_b))
    return F.when(root_a == root_b, 1.0).otherwise(shared)


def differing(sections_a: Column, sections_b: Column) -> Column:
    """Numbers, from 0, of the places at which two arrays of sections differ, those that only one has included; one look at each place."""
    same = F.zip_with(sections_a, sections_b, lambda x, y: x.eqNullSafe(y))
    return F.filter(F.transform(same, lambda s, i: F.when(~s, i)), lambda i: i.isNotNull())


def changed_sections(mark_a: Column, mark_b: Column) -> Column:
    """Numbers, from 0, of the sections in which two fingerprints differ; for equal roots none is looked at."""
    names = lambda m: F.transform(F.split(F.substring_index(m, "|", -1), ";", -1), lambda s: F.substring_index(s, "=", 1))
    return F.when(F.left(mark_a, F.lit(32)) == F.left(mark_b, F.lit(32)), F.array().cast("array<int>")).otherwise(differing(names(mark_a), names(mark_b)))


def _before(firsts: DataFrame, each: int = 1024) -> DataFrame:
    """Adds `to`, the next larger bucket (the smallest for the largest): by groups of buckets, then by groups of groups."""
    group = F.floor(F.col("bucket") / each)
    edges = firsts.groupBy(group.alias("group")).agg(F.min("bucket").alias("low"))
    order = Window.orderBy("group")  # one row for `each` buckets
    edges = edges.select("group", F.coalesce(F.lead("low").over(order), F.first("low").over(order)).alias("after"))
    within = Window.partitionBy("group").orderBy("bucket")
    placed = firsts.withColumn("group", group).withColumn("inside", F.lead("bucket").over(within))
    return placed.join(edges, "group").select("bucket", "first", F.coalesce("inside", "after").alias("to"))


def with_next(docs: DataFrame, bytes_each: int = 2 << 20) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document in descending doc_id, after the last that of the first.

    Documents are cut into ranges of doc_id, by percentiles, and each range is ordered by itself; the first
    document of the next range is added to it, so no sort passes through one task. Rows of one doc_id are
    ordered by the hash of their text; null ids come last.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bytes_all = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = common.partitions(spark, bytes_all, bytes_each)
    cuts = min(ranges, BOUNDS)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(cuts + 1)], 10_000)).first()[0] or [0, 0]
    bounds = sorted(set(bounds)) if len(set(bounds)) > 1 else [bounds[0], bounds[0] + 1]
    fine = -(-ranges // cuts)
    place = F.greatest(F.lit(1), F.least(F.lit(len(bounds) - 1), F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("doc_id")))))
    low, high = F.get(F.lit(bounds), place - 1), F.get(F.lit(bounds), place)
    part = F.greatest(F.lit(0.0), F.least(F.lit(0.999999), (F.col("doc_id") - low) / (high - low)))
    bucket = F.coalesce(place * fine + F.floor(part * fine), F.lit(-1)).cast("long") if fine > 1 else F.coalesce(place, F.lit(-1)).cast("long")
    docs = docs.withColumns({"bucket": F.when(F.col("doc_id").isNull(), -1).otherwise(bucket), "tie": F.xxhash64("text")})
    # the first document of each range goes, as a stand-in, to the end of the range before
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    firsts = _before(common.cut(docs.groupBy("bucket").agg(F.max(key).alias("first"))))
    firsts = firsts.select(F.col("bucket").alias("of"), "to", F.col("first.doc_id").alias("fid"), F.col("first.tie").alias("ftie"))
    firsts = F.broadcast(firsts) if ranges <= 100_000 else firsts
    guests = docs.join(firsts, (docs["bucket"] == F.col("of")) & (docs["tie"] == F.col("ftie")) & docs["doc_id"].eqNullSafe(F.col("fid")))
    guests = guests.dropDuplicates(["of"]).select("doc_id", "text", F.col("to").alias("bucket"), "tie", F.lit(1).alias("guest"))
    both = docs.select("doc_id", "text", "bucket", "tie", F.lit(0).alias("guest")).unionByName(guests).repartition(ranges, "bucket")
    down = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.desc("tie"))
    return both.select("doc_id", "text", F.lead("text").over(down).alias("next_text"), "guest").filter("guest = 0").drop("guest")


def fingerprint_report(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_changed, first_changed,
    last_changed) of each document: the last three say how many sections differ from the edited text's, the first and the last of them (null for none).

    digits: written of each hash below the root in the two fingerprints; roots and likenesses come from the whole
    hashes at any number.
    """
    pairs = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    found = pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(hashes(F.col(t)).alias(h) for t, h in (("text", "a"), ("edited", "b"), ("next_text", "c"))))
    # a section without paragraphs has one empty leaf, as in the written tree
    flat = lambda h: F.array_distinct(F.flatten(F.transform(h, lambda s: F.when(F.size(s) == 0, F.array(F.lit(""))).otherwise(s))))
    trees = found.select("*", *(flat(F.col(x)).alias(f"l{x}") for x in "abc"), *(tree(F.col(x)).alias(f"t{x}") for x in "ab"), *(tree(F.col(x), digits).alias(f"w{x}") for x in "ab"))
    # sections are equal where the hashes of their paragraphs are
    trees = trees.withColumn("changed", F.when(F.col("ta") == F.col("tb"), F.array().cast("array<int>")).otherwise(differing(F.col("a"), F.col("b"))))
    near = lambda x: likeness(F.col("la"), F.col(f"l{x}"), F.col("a"), F.col(x))
    return trees.select("doc_id", "n_chars", "edited_sha256", rooted(F.col("ta"), F.col("wa")).alias("fingerprint"), rooted(F.col("tb"), F.col("wb")).alias("edited_fingerprint"), near("b").alias("near_edited"), near("c").alias("near_next"), F.size("changed").cast("long").alias("n_changed"), F.get("changed", F.lit(0)).cast("long").alias("first_changed"), F.try_element_at("changed", F.lit(-1)).cast("long").alias("last_changed"))
