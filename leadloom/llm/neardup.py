"""Groups of texts that share most of their word shingles: wide SimHash fingerprints, pigeonhole blocks, exact check.

Two texts with a similarity (Jaccard, distinct shingles) of s differ in a share
``p`` of all SimHash bits that s fixes. A block of b bits is then equal with
probability (1 - p)^b. ``plan`` takes b from the number of texts, so that
unlike texts meet in a block about n/16 times whatever n is, and as many blocks
as the wanted recall needs. Texts with equal shingle sets are one node first.

1. Two passes over the first blocks compare each member of a block with one
   hub only and merge what is linked. Most copies of a text are one component
   from then on.
2. All blocks, a band at a time: nodes of different components that share a
   small block are compared; a loose limit on the first bits is part of the
   join, so that rows are short there, and what is left is held against the
   bit limit.
3. Nodes of different components in large blocks, and nodes that meet many
   others in the small blocks of a band (texts of one template, say), are
   compared by a prefix filter instead: two sets of similarity s share one of
   the 1 - s rarest shingles of either. Only shingles that several nodes hold,
   and not very many, get a row for each of them in the join with the counts.
   What all of them have in common is frequent, so it makes few pairs; the bit
   limit holds here too. Two such nodes are not compared in small blocks, so a
   band's pairs there grow with the nodes, however large a template's group is.

Blocks and bits find candidates only; the similarity of the whole shingle sets
decides. Sets are made again for candidates, not stored for all texts. A band's
tables are deleted after it.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.common import row_key, text_or_empty
from leadloom.llm.components import components
from leadloom.llm.simhash import _voted, block_keys, distinct_shingles
from leadloom.session import discard, release_shuffles, write_scratch

HUBS = 24  # blocks of each of the two passes with hubs
BAND = 96  # blocks handled together
LARGE = 128  # members of different components from which on a block goes through the prefix filter
OFTEN = 1024  # most of the shingles whose order in the prefix filter is broadcast: those that very many nodes hold
MEETINGS = 64  # with nodes of other components in a band's small blocks; a node with more goes through the prefix filter


@dataclass(frozen=True)
class Plan:
    """How wide fingerprints are: 64-bit words, bits of a block, blocks; words that are compared and their bit limit, and
    the limit of their first two words, at six deviations."""

    words: int
    block_bits: int
    blocks: int
    checked: int
    limit: int
    loose: int


def plan(texts: int, similarity: float = 0.8, recall: float = 0.998) -> Plan:
    """The plan for a number of texts: pairs of at least ``similarity`` meet in a block with probability ``recall``."""
    apart = acos(2 * similarity / (1 + similarity)) / pi
    bits = min(40, max(10, ceil(log2(max(2, texts))) + 3))
    blocks = ceil(log(1 - recall) / log(1 - (1 - apart) ** bits))
    words = max(24, ceil(blocks / (64 // bits)))
    checked = min(words, 24)
    limit = lambda n, deviations: round(apart * n + deviations * (apart * (1 - apart) * n) ** 0.5)
    return Plan(words, bits, blocks, checked, limit(64 * checked, 4), limit(128, 6))


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """(id, key, sig, size, fp) per row; sig and size: hash and number of the distinct shingles."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("shingles", pa.binary()), ("fp", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [distinct_shingles(t, shingle) for t in part.column(2).to_pylist()]
                fps = np.concatenate([_voted([s], words) for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * words), pa.array(fps))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([s.tobytes() for s in sets], pa.binary()), lists], schema=schema)

    made = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), _row_key(id_col, text_col).alias("key"),
                       F.encode(text_or_empty(F.col(f"`{text_col}`")), "UTF-8").alias("data")).mapInArrow(
        run, "id bigint, key bigint, shingles binary, fp array<bigint>")
    return made.select("id", "key", F.xxhash64("shingles").alias("sig"),
                       (F.octet_length("shingles") / 8).cast("int").alias("size"), "fp")


def _row_key(id_col: str, text_col: str) -> Column:
    return row_key(f"`{id_col}`", f"`{text_col}`")


def _distance(a: str, b: str, words: int) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(words)), F.lit(0))


class _Linker:
    """The exact check, and components so far, of the nodes of one table."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, how: Plan):
        self.docs, self.nodes, self.how, self.similarity, self.shingle = docs, nodes, how, similarity, shingle
        self.id_col, self.text_col = id_col, text_col
        self.joined: DataFrame | None = None

    def with_component(self, df: DataFrame) -> DataFrame:
        if self.joined is None:
            return df.withColumn("c", F.col("node"))
        return df.join(self.joined, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")

    def members(self, first: int, last: int) -> DataFrame:
        """(node, key) of the blocks from ``first`` to before ``last``."""
        return self.nodes.select("node", F.explode(block_keys(
            F.col("fp"), self.how.words, self.how.block_bits, first, last)).alias("key"))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes, from their texts; written."""
        shingle = self.shingle

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 100):
                    part = batch.slice(at, 100)
                    found = [distinct_shingles(t, shingle).view(np.int64) for t in part.column(1).to_pylist()]
                    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "shingles"])

        # Written, so that Spark sees how few they may be before it shuffles the texts.
        keys = write_scratch(self.nodes.select("node", F.col("key").alias("text_key")).join(
            wanted.select("node").distinct(), "node"), "wanted")
        texts = self.docs.select(_row_key(self.id_col, self.text_col).alias("key"),
                                 F.encode(text_or_empty(F.col(f"`{self.text_col}`")), "UTF-8").alias("data"))
        made = texts.join(keys, F.col("key") == F.col("text_key"), "left_semi").mapInArrow(
            run, "key bigint, shingles array<bigint>")
        once = made.groupBy("key").agg(F.first("shingles").alias("shingles"))
        out = write_scratch(keys.join(once, F.col("key") == F.col("text_key")).select("node", "shingles"), "sets")
        discard(keys)
        return out

    def merge(self, pairs: DataFrame) -> None:
        """Join the components of pairs (a, b) that are similar enough; ``pairs`` is written and deleted here."""
        pairs = write_scratch(pairs.distinct(), "candidates")
        sets = self.sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
        both = F.size(F.array_intersect("x", "y"))
        links = write_scratch(
            pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
            .where(both >= self.similarity * (F.size("x") + F.size("y") - both)).select("a", "b"), "links")
        edges = links if self.joined is None else links.unionByName(
            self.joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
        before, self.joined = self.joined, write_scratch(components(edges), "joined")
        discard(pairs, sets, links, *([before] if before is not None else []))
        release_shuffles(self.nodes.sparkSession)

    def heads(self, *more: str) -> DataFrame:
        return self.nodes.select("node", F.slice("fp", 1, self.how.checked).alias("head"), *more)

    def with_hubs(self, first: int, last: int) -> None:
        """Compare the members of each block with one of them: the smallest node of the largest component there."""
        members = write_scratch(self.with_component(self.members(first, last)), "blocks")
        parts = members.groupBy("key", "c").agg(F.count("*").alias("n"), F.min("node").alias("node"))
        hubs = parts.groupBy("key").agg(F.max(F.struct("n", (-F.col("node")).alias("least"), "c")).alias("hub"),
                                        F.count("*").alias("parts")).where("parts > 1")
        met = members.join(hubs.select("key", (-F.col("hub.least")).alias("hub"), F.col("hub.c").alias("hub_c")), "key").where(
            "c <> hub_c").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        self.merge(self.within_limit(met))
        discard(members)

    def within_limit(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) within the bit limit."""
        left, right = (self.heads().select(F.col("node").alias(x), F.col("head").alias(f"{x}_head")) for x in "ab")
        return pairs.join(left, "a").join(right, "b").where(
            _distance("a_head", "b_head", self.how.checked) <= self.how.limit).select("a", "b")

    def in_blocks(self) -> None:
        """Compare nodes of different components that share any block."""
        found, large = [], []
        for first in range(0, self.how.blocks, BAND):
            members = self.members(first, min(first + BAND, self.how.blocks))
            shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
            held = self.with_component(members.join(shared.select("key"), "key", "left_semi"))
            held = write_scratch(held, "blocks")
            parts = write_scratch(held.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"))
                                  .where("c0 < c1").select("key", "n"), "open")
            small = held.join(parts.where(F.col("n") <= LARGE), "key")
            own = small.groupBy("key", "c").agg(F.count("*").alias("own"))
            busy = write_scratch(small.join(own, ["key", "c"]).groupBy("node", "c").agg(F.sum(F.col("n") - F.col("own")).alias("met"))
                                 .where(F.col("met") > MEETINGS).select("node", "c"), "busy")
            small = small.drop("n").join(
                self.nodes.select("node", "size", F.slice("fp", 1, 2).alias("head")), "node").join(
                busy.select("node", F.lit(True).alias("busy")), "node", "left").withColumn("busy", F.coalesce("busy", F.lit(False)))
            a, b = small.alias("a"), small.alias("b")
            lower, upper = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
            near = ((F.col("a.key") == F.col("b.key")) & (F.col("a.c") < F.col("b.c")) & ~(F.col("a.busy") & F.col("b.busy"))
                    & (lower >= self.similarity * upper) & (_distance("a.head", "b.head", 2) <= self.how.loose))
            found.append(write_scratch(a.join(b, near).select(
                F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct(), "pairs"))
            large.append(write_scratch(held.join(parts.where(F.col("n") > LARGE).select("key"), "key", "left_semi")
                                       .select("node", "c").unionByName(busy).distinct(), "large"))
            discard(held, parts, busy)
            release_shuffles(self.nodes.sparkSession)
        pairs = self.within_limit(_all(found).distinct())
        many = _all(large).distinct()
        if not many.isEmpty():
            pairs = pairs.unionByName(self.by_prefix(many))
        self.merge(pairs)
        discard(*found, *large)

    def by_prefix(self, some: DataFrame) -> DataFrame:
        """Pairs of different components among ``some`` nodes (node, c) that can be similar enough by prefix and bits.

        Shingles are ordered by how many of these nodes hold them, rarest first.
        Of a set of n shingles the first n - ceil(s n) + 1 are its prefix; sets
        of similarity s share a shingle of both prefixes. They have s / (1 + s)
        of their shingles, counted together, in common, and none of them stands
        before the first that is in both prefixes: at places i and j (from 0)
        at most n - i or m - j are left. For the smaller set that is a share of
        2 s / (1 + s) of its own shingles at least, so one with many shingles
        that no other node holds is not looked for by larger ones.
        """
        sets = self.sets(some)
        held = write_scratch(sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
            F.count("*").alias("df")).where("df > 1"), "held")
        most = max(LARGE, (held.agg(F.sum("df")).first()[0] or 0) // OFTEN)
        often = held.where(F.col("df") > most).agg(F.sort_array(F.collect_list(F.struct("df", "shingle")))["shingle"].alias("often"))
        parts = write_scratch(some.join(sets, "node").crossJoin(F.broadcast(often)).select(
            "node", "c", F.size("shingles").alias("n"), F.array_except("shingles", "often").alias("rare"),
            F.array_intersect("often", "shingles").alias("often")), "parts")
        ordered = _with_counts(parts, held.where(F.col("df") <= most)).groupBy("node").agg(
            F.sort_array(F.collect_list(F.struct("df", "shingle")))["shingle"].alias("shared"))
        shared = F.coalesce("shared", F.array().cast("array<bigint>"))
        alone = F.size("rare") - F.size(shared)  # the rarest, so they stand in front
        length = F.col("n") - F.ceil(self.similarity * F.col("n")).cast("int") + 1 - alone
        prefix = write_scratch(parts.join(ordered, "node", "left").where(length > 0).select(
            "node", "c", "n", alone.alias("alone"), F.slice(F.concat(shared, "often"), F.lit(1), length).alias("prefix")).join(
            self.heads(), "node"), "prefixes")
        rows = prefix.select("*", F.posexplode("prefix").alias("at", "shingle")).withColumn(
            "rest", F.col("n") - F.col("alone") - F.col("at")).drop("alone", "at")
        least = self.similarity / (1 + self.similarity)
        a, b = rows.alias("a"), rows.where(F.col("rest") >= 2 * least * F.col("n") - 1e-6).alias("b")
        # A pair comes out at its first common shingle only, and only within the bit limit.
        pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.c") != F.col("b.c"))
                       & (F.struct("b.n", "b.node") < F.struct("a.n", "a.node"))
                       & (F.col("b.n") >= self.similarity * F.col("a.n"))
                       & (F.least("a.rest", "b.rest") >= least * (F.col("a.n") + F.col("b.n")) - 1e-6)
                       & (_distance("a.head", "b.head", self.how.checked) <= self.how.limit)
                       & (F.array_intersect("a.prefix", "b.prefix")[0] == F.col("a.shingle"))).select(
            F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
        pairs = write_scratch(pairs, "pairs")
        discard(sets, held, parts, prefix)
        return pairs


def _with_counts(parts: DataFrame, held: DataFrame) -> DataFrame:
    """(node, shingle, df) of the shingles in ``rare`` that other nodes hold too; one row for each at most."""
    return parts.select("node", F.explode("rare").alias("shingle")).join(held, "shingle")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float = 0.8,
                recall: float = 0.998) -> DataFrame:
    """(id, key, group) per row of ``docs``; key: ``row_key``, group: a number of the group.

    Texts are in one group if a chain of links of at least ``similarity`` joins
    them. Null and empty texts have no shingles and form one group; repeated
    rows get a row each; an empty table gives an empty table. Words are lower-
    cased (A-Z) and broken at ASCII blanks; a text of fewer words is one shingle.
    """
    how = plan(docs.count(), similarity, recall)
    rows = write_scratch(_fingerprints(docs, id_col, text_col, shingle, how.words)
                         .withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    # The hash, the number and 64 bits of the fingerprint tell sets of shingles apart.
    same = [F.col("sig"), F.col("size"), F.col("fp")[0].alias("fp0")]
    nodes = write_scratch(rows.groupBy(*same).agg(
        F.min("row").alias("node"), F.min_by("key", "row").alias("key"), F.first("fp").alias("fp")), "nodes")
    linker = _Linker(docs, nodes, id_col, text_col, shingle, similarity, how)
    hubs = min(HUBS, how.blocks)
    linker.with_hubs(0, hubs)
    linker.with_hubs(max(0, min(hubs, how.blocks - hubs)), min(2 * hubs, how.blocks))
    linker.in_blocks()
    placed = linker.with_component(nodes.select("sig", "size", "fp0", "node"))
    out = write_scratch(rows.select("id", "key", *same).join(placed, ["sig", "size", "fp0"]).select(
        "id", "key", F.col("c").alias("group")), "groups")
    discard(rows, nodes, linker.joined)
    release_shuffles(docs.sparkSession)
    return out


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without near duplicates: of each group the row with the smallest id stays (rows without id last).

    Of rows with equal ids the one with the smallest row key stays, of equal
    rows (same id and text) any one. All columns come back as they are,
    whatever their names.
    """
    found = near_groups(docs, id_col, text_col, **how)
    per_row = found.groupBy("group", "id", "key").agg(F.count("*").alias("n"))
    best = write_scratch(per_row.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("best"))
                         .select("best.id", "best.key", "best.n"), "keepers")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"),
                         F.col(f"`{id_col}`").cast("bigint").alias("id"), _row_key(id_col, text_col).alias("key"))

    def kept(keepers: DataFrame) -> DataFrame:
        k = keepers.alias("k")
        return packed.alias("d").join(k, (F.col("d.key") == F.col("k.key")) & F.col("d.id").eqNullSafe(F.col("k.id")), "left_semi")

    out = kept(best.where("n = 1"))
    if not best.where("n > 1").isEmpty():
        out = out.unionByName(kept(best.where("n > 1")).dropDuplicates(["key", "id"]))
    return out.select("whole.*")
