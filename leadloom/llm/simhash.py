"""SimHash fingerprints and near-duplicate groups by pigeonhole blocks.

A fingerprint bit is the majority vote of that bit over the hashes of all word
shingles. Two fingerprints that differ in few bits agree on whole blocks of
bits, so candidates meet on block keys and are then held against the bit
limit.

* Up to ``max_distance`` differing bits of 64: with ``blocks`` blocks at least
  ``blocks - max_distance`` agree, so one key per choice of that many blocks
  finds every pair (exact).
Copies collapse to one node per distinct fingerprint first. A block may hold
any number of nodes, so large blocks are not expanded into all their pairs: two
values differ in at most two bits exactly if some value differs from both in at
most one. Nodes of large blocks meet on these values, 65 per node, and each
value links its nodes to the smallest one.

Wide fingerprints (several 64-bit words, one key per block) are made here too;
``neardup`` links them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.common import row_key, text_or_empty
from leadloom.llm.components import components
from leadloom.session import write_scratch

SEED = 42
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
_HASH = partial(xxhash.xxh64_intdigest, seed=SEED)
_PIECE = 1 << 20


def _word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte at a time."""
    at = 0
    while at < len(data):
        found = _BREAK.search(data, at + _PIECE)
        end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def shingle_hashes(data: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of ``words`` words, A-Z lower-cased, in runs; fewer words: of the whole sequence."""
    kept: list[bytes] = []
    made = False
    for run in _word_runs(data.lower()):
        kept += run
        n = len(kept) - words + 1
        if n > 0:
            made = True
            yield np.fromiter(map(_HASH, map(b" ".join, zip(*(kept[i:] for i in range(words))))), np.uint64, n)
            kept = kept[n:]
    if not made and kept:
        yield np.array([_HASH(b" ".join(kept))], np.uint64)


def _widen(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n, words) 64-bit words per hash; the first is the hash itself, the others are mixed from it."""
    if words == 1:
        return hashes[:, None]
    x = hashes[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[:, 0] = hashes
    return x


def simhash(data: bytes, shingle: int, words: int = 1, once: bool = False) -> np.ndarray:
    """Fingerprint of one text: ``words`` int64 values; all zero for a text without words.

    ``once``: count each distinct shingle once instead of every occurrence.
    """
    return _voted([distinct_shingles(data, shingle)] if once else shingle_hashes(data, shingle), words)


def distinct_shingles(data: bytes, shingle: int) -> np.ndarray:
    """The different shingle hashes of a text in ascending order."""
    found = list(shingle_hashes(data, shingle))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _voted(runs: Iterable[np.ndarray], words: int) -> np.ndarray:
    votes, total = np.zeros(64 * words, np.int64), 0
    for hashes in runs:
        total += len(hashes)
        step = max(255, (1 << 17) // words // 255 * 255)
        for at in range(0, len(hashes), step):
            wide = _widen(hashes[at:at + step], words)
            bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
            for i in range(0, len(bits), 255):  # 255 ones fit a byte
                votes += np.add.reduce(bits[i:i + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > total, bitorder="little").view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3,
                 words: int = 1) -> DataFrame:
    """(id, key, fp) per row; fp: array of ``words`` bigints; key: ``row_key``. Null text counts as empty."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("fp", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                values = [simhash(t, shingle, words) for t in part.column(2).to_pylist()]
                flat = pa.array(np.concatenate(values))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * words), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), row_key(id_col, text_col).alias("key"),
                       F.encode(text_or_empty(F.col(text_col)), "UTF-8").alias("data")).mapInArrow(
        run, "id bigint, key bigint, fp array<bigint>")


def pigeonhole_keys(fp: Column, max_distance: int = 2, blocks: int = 4) -> Column:
    """Keys of a 64-bit fingerprint: every choice of ``blocks - max_distance`` equal blocks, marked with its number."""
    size = 64 // blocks
    parts = [F.shiftrightunsigned(fp[0], i * size).bitwiseAND(F.lit((1 << size) - 1).cast("bigint"))
             for i in range(blocks)]
    return F.array(*[F.xxhash64(F.lit(n), *[parts[i] for i in chosen])
                     for n, chosen in enumerate(combinations(range(blocks), blocks - max_distance))])


def block_keys(fp: Column, words: int, block_bits: int = 24, first: int = 0, last: int | None = None) -> Column:
    """Keys of a wide fingerprint: each block of ``block_bits`` bits, marked with its number; from ``first`` to before ``last``."""
    mask = F.lit((1 << block_bits) - 1).cast("bigint")
    each = 64 // block_bits
    return F.array(*[F.shiftrightunsigned(fp[w], k * block_bits).bitwiseAND(mask)
                     + F.lit((w * each + k) << 40).cast("bigint")
                     for w, k in [divmod(i, each) for i in range(words * each)][first:last]])


def link_exact(nodes: DataFrame, max_distance: int = 2, blocks: int = 4, pairs_up_to: int = 256) -> DataFrame:
    """(node, component) of all nodes linked to another one; 64-bit fingerprints, at most two differing bits."""
    if max_distance != 2:  # the way through values one bit away joins what differs in two bits
        raise ValueError("64-bit fingerprints link at two differing bits")
    members = write_scratch(nodes.select("node", F.col("fp")[0].alias("v"), F.explode(
        pigeonhole_keys(F.col("fp"), max_distance, blocks)).alias("key")), "blocks")
    sizes = write_scratch(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    near = F.bit_count(F.col("a.v").bitwiseXOR(F.col("b.v"))) <= max_distance
    small = members.join(sizes.where(F.col("n") <= pairs_up_to), "key", "left_semi")
    pairs = small.alias("a").join(small.alias("b"), (F.col("a.key") == F.col("b.key"))
                                  & (F.col("a.node") < F.col("b.node")) & near).select(
        F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    large = members.join(sizes.where(F.col("n") > pairs_up_to), "key", "left_semi").select("node", "v").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("v").bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    around = large.select("node", "v", F.explode(F.concat(F.array("v"), flips)).alias("value"))
    hubs = around.groupBy("value").agg(F.min(F.struct("node", "v")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(hubs, "value").where(
        (F.col("node") != F.col("hub.node")) & (F.bit_count(F.col("v").bitwiseXOR(F.col("hub.v"))) <= max_distance)).select(
        F.col("hub.node").alias("a"), F.col("node").alias("b"))
    return components(pairs.unionByName(stars))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3,
                    max_distance: int = 2, blocks: int = 4) -> DataFrame:
    """(id, key, fp, component, group) per row of ``docs``.

    component: the smallest id reachable by links of at most ``max_distance``
    differing bits of 64, itself included; null if no row of the group has an
    id. group: a number of the group. Null and empty texts have the zero
    fingerprint and are linked like any other; repeated rows get a row each; an
    empty table gives an empty table.
    """
    rows = fingerprints(docs, id_col, text_col, shingle=shingle)
    rows = write_scratch(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    nodes = write_scratch(rows.groupBy("fp").agg(F.min("row").alias("node"), F.min("id").alias("least")), "nodes")
    joined = link_exact(nodes, max_distance, blocks)
    placed = write_scratch(nodes.join(joined, "node", "left")
                           .select("fp", "least", F.coalesce("component", "node").alias("group")), "placed")
    named = placed.groupBy("group").agg(F.min("least").alias("component"))
    return (rows.join(placed.join(named, "group").select("fp", "component", "group"), "fp")
            .select("id", "key", "fp", "component", "group"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp[0])), 16, "0")
