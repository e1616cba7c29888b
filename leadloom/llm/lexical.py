"""Ranked lexical search of many items at once, with shared parts of the items evaluated once.

Every task holds some documents and answers all items of a block for them.
An item is a set of terms; its score of a document is a sum over the terms. What
several items have in common is a node of a sharing graph, and its partial
scores (one accumulator per document) are made once:

* terms that stand in exactly the same items are one leaf;
* the leaves of an item, the most shared ones first, are a sequence; pairs that
  lie near each other in several sequences are counted, and the most frequent
  ones become nodes in place of their parts, round after round (``share``).

An item is the sum of the few nodes left in its sequence. A task keeps the best
documents of every item seen so far, so no more than ``top`` rows per item and
task are shuffled.

Items come in blocks of a bounded number of characters; only the terms of one
block are at hand at a time. The documents are cut into terms once per block,
in which only the block's terms are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leadloom.llm.common import text_or_empty
from leadloom.session import write_scratch

#: Characters of a term: all but the ASCII ones that are neither digits nor letters; only A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
TOP = 10
BLOCK_BYTES = 1 << 20
NEAR, ROUNDS = 32, 12  # how far apart shared pairs are looked for, and how often
_CELLS = 1 << 22  # accumulators held at once
_PIECE = 1 << 22


def terms_of(data: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return data.translate(_FOLD).split()


def _runs(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    at = 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and _FOLD[data[end]] != 32:
            end += 1
        yield terms_of(data[at:end])
        at = end


# --- the sharing graph --------------------------------------------------------------

@dataclass
class Sharing:
    """Leaves 0 .. n-1 (``leaf_of`` each term), nodes n .. (pairs of earlier nodes, in levels), nodes of every item."""

    leaf_of: np.ndarray
    leaves: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    nodes: int
    items: list[list[int]]
    additions: tuple[int, int]  # per document: without sharing, with it


def share(items: list[list[int]], n_terms: int) -> Sharing:
    """The sharing graph of items that are lists of different term numbers."""
    holders: list[list[int]] = [[] for _ in range(n_terms)]
    for i, found in enumerate(items):
        for t in found:
            holders[t].append(i)
    numbers: dict[tuple[int, ...], int] = {}
    leaf_of = np.array([numbers.setdefault(tuple(h), len(numbers)) for h in holders], np.int64)
    shared = [0] * len(numbers)
    for h, k in numbers.items():
        shared[k] = len(h)
    rows = [sorted({int(leaf_of[t]) for t in found}, key=lambda k: (-shared[k], k)) for found in items]
    level = [0] * len(numbers)
    made: list[tuple[int, int, int]] = []  # (node, its parts)
    for _ in range(ROUNDS):
        counts = Counter(p for row in rows for p in _near_pairs(row))
        wanted = sorted((p for p, n in counts.items() if n > 1), key=lambda p: (-counts[p], p))
        if not wanted:
            break
        partner: dict[int, tuple[int, int]] = {}  # a node is joined with one other per round
        for a, b in wanted:
            if a not in partner and b not in partner:
                partner[a], partner[b] = (b, len(level)), (a, len(level))
                made.append((len(level), a, b))
                level.append(1 + max(level[a], level[b]))
        rows = [_joined(row, partner) for row in rows]
    by_level: dict[int, list[tuple[int, int, int]]] = {}
    for m in made:
        by_level.setdefault(level[m[0]], []).append(m)
    levels = [tuple(np.array(x, np.int64) for x in zip(*by_level[k])) for k in sorted(by_level)]
    plain = sum(max(0, len(found) - 1) for found in items)
    with_nodes = sum(map(bool, holders)) - sum(map(bool, numbers)) + len(made) + sum(max(0, len(r) - 1) for r in rows)
    return Sharing(leaf_of, len(numbers), levels, len(level), rows, (plain, with_nodes))


def _near_pairs(row: list[int]) -> Iterator[tuple[int, int]]:
    for i, a in enumerate(row):
        for b in row[i + 1:i + NEAR]:
            yield (a, b) if a < b else (b, a)


def _joined(row: list[int], partner: dict[int, tuple[int, int]]) -> list[int]:
    """A row with a node in place of both its parts, where the first one stood."""
    held, gone, out = set(row), set(), []
    for a in row:
        b, node = partner.get(a, (None, None))
        if a in gone:
            continue
        if b in held:
            gone.add(b)
        out.append(node if b in held else a)
    return out


# --- scores -------------------------------------------------------------------------

def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` documents with terms hold."""
    return floor(1000 * log((2 * documents + 2) / (2 * holding + 1)))


class _Best:
    """The best documents of every item seen so far: by score, then by id (none last)."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.id, self.none = np.zeros(0, np.int64), np.zeros(0, bool)
        self.least = np.zeros(items, np.int64)  # a document below can't enter any more

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Scores [item, document]."""
        item, doc = np.nonzero((scores > 0) & (scores >= self.least[:, None]))
        if not len(item):
            return
        item, score = np.append(self.item, item), np.append(self.score, scores[item, doc])
        ids, none = np.append(self.id, ids[doc]), np.append(self.none, none[doc])
        order = np.lexsort((ids, none, -score, item))
        ordered = item[order]
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        place = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
        keep, last = order[place < self.top], order[place == self.top - 1]
        self.least[item[last]] = score[last]
        self.item, self.score, self.id, self.none = item[keep], score[keep], ids[keep], none[keep]


def _impacts(places: np.ndarray, tf: np.ndarray, weights: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights[places] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _evaluate(graph: Sharing, doc: np.ndarray, places: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
    """Scores [item, document] of n documents from their postings."""
    held = np.zeros((graph.nodes, n), np.int64)
    np.add.at(held.reshape(-1), graph.leaf_of[places] * n + doc, impact)
    for node, a, b in graph.levels:
        held[node] = held[a] + held[b]
    out = np.zeros((len(graph.items), n), np.int64)
    for i, nodes in enumerate(graph.items):
        for k in nodes:
            out[i] += held[k]
    return out


def _postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, places, tfs) of every document with terms: its length, and its terms of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            out = ([], [], [], [])
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, found = 0, Counter()
                for words in _runs(data.as_py()):
                    n += len(words)
                    found.update(map(vocabulary.get, words))
                if n:
                    found.pop(None, None)
                    for column, v in zip(out, (doc, n, list(found.keys()), list(found.values()))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32())),
                pa.array(out[3], pa.list_(pa.int64()))], names=["id", "n", "places", "tfs"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                       F.encode(text_or_empty(F.col(f"`{text_col}`")), "UTF-8").alias("data")).mapInArrow(
        run, "id bigint, n bigint, places array<int>, tfs array<bigint>")


def _holding(postings: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of a vocabulary of ``size`` terms."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["place", "df"])

    found = postings.select("places").mapInArrow(run, "place int, df bigint").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def _search_block(docs: DataFrame, items: list[tuple[int, bytes]], id_col: str, text_col: str, top: int) -> DataFrame:
    """(row, id, score): the best documents of every item and task; items: (row, text)."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    wanted = [[vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms_of(text))] for _, text in items]
    postings = write_scratch(_postings(docs, vocabulary, id_col, text_col), "postings")
    size = len(vocabulary)
    count, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([weight(count, int(h)) for h in _holding(postings, size)], np.int64) if size else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((share(wanted, size), weights, np.array([row for row, _ in items], np.int64)))

    def run(batches):
        graph, weights, rows = shared.value
        best = _Best(len(rows), top)
        step = max(1, _CELLS // max(1, graph.nodes))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = part.num_rows
                sizes = part.column(2).value_lengths().to_numpy()
                doc = np.repeat(np.arange(n), sizes)
                places, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                m = 10 + (90 * part.column(1).to_numpy() * count) // length
                impact = _impacts(places, tf, weights, m[doc])
                none = part.column(0).is_null().to_numpy(zero_copy_only=False)
                best.add(_evaluate(graph, doc, places, impact, n), part.column(0).fill_null(0).to_numpy(), none)
        ids = pa.array(best.id, pa.int64(), mask=best.none)
        yield pa.RecordBatch.from_arrays([pa.array(rows[best.item]), ids, pa.array(best.score)], names=["row", "id", "score"])

    return postings.mapInArrow(run, "row bigint, id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, id, score): of every item the ``top`` documents with the highest scores above 0.

    Equal scores go by ascending id, documents without id last; repeated
    documents are ranked each, and a repeated item has its ranks once per row.
    Null and empty texts have no terms: such documents are never found (nor
    counted), such items find nothing. Empty tables give an empty table; other
    columns of both tables don't matter, whatever their names.

    Items are handed to the tasks in blocks of about ``block_bytes`` bytes of
    text; a block's terms, weights and sharing graph are the only broadcast.
    """
    spark = docs.sparkSession
    listed = write_scratch(items.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{item_col}`").alias("item"),
        F.encode(text_or_empty(F.col(f"`{item_text_col}`")), "UTF-8").alias("data")), "items")
    total = listed.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    blocks = max(1, ceil(total / block_bytes))
    parts = []
    for k in range(blocks):
        block = listed.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).select("row", "data")
        found = [(r.row, bytes(r.data)) for r in block.toLocalIterator()]
        if found:
            parts.append(write_scratch(_search_block(docs, found, id_col, text_col, top), "found") if blocks > 1
                         else _search_block(docs, found, id_col, text_col, top))
    if not parts:
        return spark.createDataFrame([], f"item {listed.schema['item'].dataType.simpleString()}, rank int, id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(listed.select("row", "item"), "row").select("item", "rank", "id", "score")
