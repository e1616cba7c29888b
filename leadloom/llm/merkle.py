"""Merkle trees over documents, in Column expressions only.

A text is sections (cut at blank lines), a section paragraphs (cut at line
ends), a paragraph parts (sentences, at most 200 characters plus their end
marks). Parts are leaves; each node hashes its children in order. The cuts can
be undone, so equal roots mean equal texts, and where roots differ the
differing branches lead to the edited paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.llm.common import row_key, text_or_empty, width
from leadloom.operators.slices import _slice_of

PART = r"[^.!?]{1,200}[.!?]*|[.!?]+"


def tree(text: Column) -> Column:
    """struct<root, sections: array<struct<hash, paragraphs: array<struct<hash, parts: array<string>>>>>>.

    Null counts as empty: one section with one paragraph without parts.
    """
    def paragraph(p: Column) -> Column:
        return F.transform(F.array(F.transform(F.regexp_extract_all(p, F.lit(PART), 0), F.md5)), lambda parts: F.struct(
            F.md5(F.array_join(parts, ",")).alias("hash"), parts.alias("parts")))[0]

    def section(s: Column) -> Column:
        return F.transform(F.array(F.transform(F.split(s, "\n", -1), paragraph)), lambda ps: F.struct(
            F.md5(F.array_join(F.transform(ps, lambda p: p["hash"]), ",")).alias("hash"), ps.alias("paragraphs")))[0]

    sections = F.transform(F.split(text_or_empty(text), "\n\n", -1), section)
    return F.transform(F.array(sections), lambda ss: F.struct(
        F.sha2(F.array_join(F.transform(ss, lambda s: s["hash"]), ","), 256).alias("root"), ss.alias("sections")))[0]


def leaves(node: Column) -> Column:
    return F.flatten(F.transform(node["sections"], lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["parts"]))))


def likeness(a: Column, b: Column) -> Column:
    """Share of common leaves among all leaves of two trees, 0 to 1; equal roots give 1."""
    both, either = F.size(F.array_intersect(leaves(a), leaves(b))), F.size(F.array_union(leaves(a), leaves(b)))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both, either), F.lit(0.0)))


def differences(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>> (from 0) of the branches that differ; equal branches are not entered."""
    def places(x: Column, y: Column) -> Column:
        n = F.greatest(F.coalesce(F.size(x), F.lit(0)), F.coalesce(F.size(y), F.lit(0)))
        return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                        lambda i: ~F.get(x, i)["hash"].eqNullSafe(F.get(y, i)["hash"]))

    def inside(i: Column) -> Column:
        x, y = F.get(a["sections"], i)["paragraphs"], F.get(b["sections"], i)["paragraphs"]
        return F.transform(places(x, y), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    return F.flatten(F.transform(places(a["sections"], b["sections"]), inside))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tree) per row; repeated rows get a row each, an empty table gives an empty table."""
    return docs.select(F.col(id_col).alias("id"), tree(F.col(text_col)).alias("tree"))


def _numbered_slice(quantiles: list[int], pieces: int) -> Column:
    """Ascending slice number by (position, key); a position that several quantiles fall on gets as many slices more."""
    borders = sorted(set(quantiles))
    position, part = F.col("position"), _slice_of(F.col("position"), borders)
    # Row keys are hashes, so equal ranges of them hold about equally many rows.
    share = (F.col("key").cast("double") + 2.0**63) / 2.0**64
    inside = F.lit(0)
    for place, (value, times) in enumerate(((b, quantiles.count(b)) for b in borders), 1):
        if times > 1:
            inside = F.when(position == value, F.least(F.floor(share * times), F.lit(times - 1)).cast("int")).when(
                part == place, times).otherwise(inside)
    return part * (pieces + 1) + inside


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next_text): the text of the next row by descending id; after the last comes the first.

    Null ids come last; equal ids go by row key. The table is cut into slices
    at quantiles of the id and shuffled once; each slice also gets the first
    row of the slice that follows it. A single row is its own next. Rows of one
    id (or none) that fill several slices are cut by their row key.
    """
    floor = F.lit(-(1 << 63)).cast("bigint")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), row_key(id_col, text_col).alias("key"),
                       text_or_empty(F.col(text_col)).alias("text"),
                       F.coalesce(F.col(id_col).cast("bigint"), floor).alias("position"))
    pieces = width(docs.sparkSession)
    shares = [i / pieces for i in range(1, pieces)]
    quantiles = (rows.select(F.percentile_approx("position", shares, 10_000).alias("q")).first().q if shares else None) or []
    rows = rows.withColumn("slice", _numbered_slice(sorted(quantiles), pieces))
    # One row per slice from here on, so the window and the broadcast hold at most ``pieces`` rows.
    tops = rows.groupBy("slice").agg(F.max(F.struct("position", "key")).alias("top"))
    above = Window.orderBy("slice")
    ends = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = tops.select("top.*", "slice", F.coalesce(F.lead("slice").over(above), F.first("slice").over(ends))
                          .alias("to"), F.lead("slice").over(above).isNull().alias("wraps"))
    guests = (rows.join(F.broadcast(carried), ["position", "key", "slice"]).groupBy("to", "wraps")
              .agg(F.first("text").alias("text"), F.max("position").alias("position"), F.max("key").alias("key"))
              .select(F.lit(None).cast("bigint").alias("id"), "key", "text", "position", F.col("to").alias("slice"),
                      F.when(F.col("wraps"), 2).otherwise(1).alias("guest")))
    every = rows.withColumn("guest", F.lit(0)).unionByName(guests)
    order = Window.partitionBy("slice").orderBy("guest", F.desc("position"), F.desc("key"))
    return (every.withColumn("next_text", F.lead("text").over(order)).where("guest = 0")
            .select("id", "text", "next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last third of ``text`` replaced by the first as many characters of ``following``."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(following, F.lit(1), k))
