"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens; full pieces are
sequences of their own. The other pieces are spread over blocks of bounded
size by a hash of their row number, so no key gathers in a block. A block is
packed by several islands, each a population of packings:

* start: best fit over the pieces, largest first, and over shuffled orders;
* crossover: whole well-filled bins of one parent are injected into the other,
  bins that then hold a piece twice are removed, and the displaced pieces are
  put back by best fit;
* mutation: the emptiest bins are dissolved and their pieces put back;
* after each epoch the best packing of an island migrates to the next one.

A block stops when it has as few bins as its token count allows.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leadloom.llm.common import text_or_empty
from leadloom.session import write_scratch

CAPACITY, END_ID = 4096, 1
_PUNCTUATION = ".,!?;:%$&*#"
_PIECE = 1 << 20


# --- tokens -----------------------------------------------------------------

def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be printed, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in shown)}


class WordIds(dict):
    """Chunks between blanks and line ends -> their ids, as little-endian 32-bit numbers; learnt on demand.

    The tokenizer drops white space, never joins anything across it, nor a
    letter with a following run of punctuation, so a text's ids are those of
    its parts in order. Runs of letters are one word: normaliser and model
    take them alone; other parts go through the whole tokenizer. A full table
    is emptied, so memory stays bounded.
    """

    def __init__(self, path: str, most_chunks: int = 800_000, most_parts: int = 1_000_000):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalize = self.tokenizer.model, self.tokenizer.normalizer.normalize_str
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.most_chunks, self.most_parts = most_chunks, most_parts

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            word = part if part.isascii() else self.normalize(part)
            if word.isalpha():
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(self.letters)
                ids = [t.id for t in self.model.tokenize(word)]
            else:
                ids = self.tokenizer.encode(part, add_special_tokens=False).ids
            found = array("I", ids).tobytes()
            if len(self.parts) >= self.most_parts:
                self.parts.clear()
            self.parts[part] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(_PUNCTUATION)
        lower = core.lower() if core.isascii() else core
        if len(core) == len(chunk):
            found = self._part(lower if core.isalpha() else chunk)
        elif core and core[-1].lower().isalpha():
            found = self._part(lower if core.isalpha() else core) + self._part(chunk[len(core):])
        else:
            found = self._part(chunk)
        if len(self) >= self.most_chunks:
            self.clear()
            self[""] = b""
        self[chunk] = found
        return found

    def of(self, text: str) -> bytes:
        """Ids of a whole text; a very long one is split a piece at a time."""
        if len(text) <= _PIECE:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + _PIECE)
            end = len(text) if end < 0 else end
            out.append(b"".join(map(self.__getitem__, text[at:end].replace("\n", " ").split(" "))))
            at = end
        return b"".join(out)


_KEPT: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table per Python worker."""
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32) of every piece, written once to the shared folder.

    A document's ids, then ``end_id``; only longer ones are cut. A null or
    empty text is the end mark alone. The ids themselves are made again by
    ``sequences`` callers that need them; packing needs lengths only.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = word_ids(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = ([], [], [], [], [])
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = words.of(text) + end
                    for n, begin in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[begin:begin + 4 * capacity]
                        for column, v in zip(out, (doc, n, begin // 4, len(cut) // 4, zlib.crc32(cut))):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    cut = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")
                      ).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    return write_scratch(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")


# --- packings of one block ----------------------------------------------------

class Room:
    """Open bins by free space; finds the fullest bin that a size fits into."""

    def __init__(self, capacity: int):
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, bin_no: int, space: int) -> None:
        self.by_space[space].append(bin_no)
        self.mask |= 1 << space

    def take(self, size: int) -> tuple[int, int] | None:
        above = self.mask >> size
        if not above:
            return None
        space = size + (above & -above).bit_length() - 1
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            self.mask &= ~(1 << space)
        return found, space


def best_fit(order: list[int], sizes: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """``bins`` with the items of ``order`` added by best fit; new bins where none has room."""
    bins = bins if bins is not None else []
    room = Room(capacity)
    for n, items in enumerate(bins):
        room.put(n, capacity - sum(sizes[i] for i in items))
    for i in order:
        size = sizes[i]
        found = room.take(size)
        if found is None:
            bins.append([i])
            room.put(len(bins) - 1, capacity - size)
        else:
            bins[found[0]].append(i)
            room.put(found[0], found[1] - size)
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> float:
    """Mean squared fill: fewer bins first, then uneven fill, which leaves room to close bins."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng) -> list[list[int]]:
    """``a`` with a share of the best-filled bins of ``b`` injected whole."""
    fill = [sum(sizes[i] for i in items) for items in b]
    ranked = sorted(range(len(b)), key=lambda n: (-fill[n], n))
    half = ranked[:max(1, len(ranked) // 2)]
    picked = [b[n] for n in rng.permutation(half)[:max(1, len(half) // 2)]]
    inside = {i for items in picked for i in items}
    child, displaced = [list(items) for items in picked], []
    for items in a:
        if inside.isdisjoint(items):
            child.append(list(items))
        else:
            displaced += [i for i in items if i not in inside]
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(displaced, sizes, capacity, child)


def mutated(bins: list[list[int]], sizes: list[int], capacity: int, rng, share: float = 0.05) -> list[list[int]]:
    """The emptiest bins and a few others dissolved and put back by best fit."""
    fill = [sum(sizes[i] for i in items) for items in bins]
    ranked = sorted(range(len(bins)), key=lambda n: (fill[n], n))
    k = max(2, int(len(bins) * share))
    gone = set(ranked[:k]) | set(rng.integers(0, len(bins), k).tolist())
    loose = sorted((i for n in gone for i in bins[n]), key=lambda i: (-sizes[i], i))
    return best_fit(loose, sizes, capacity, [list(items) for n, items in enumerate(bins) if n not in gone])


def evolve(sizes: list[int], capacity: int, population: list[list[list[int]]], generations: int, rng) -> list:
    """The population after some generations, best first; ends early at the least possible number of bins."""
    least = -(-sum(sizes) // capacity)
    score = lambda bins: (len(bins), -fitness(bins, sizes, capacity))
    ranked = sorted(((score(p), n, p) for n, p in enumerate(population)), key=lambda x: x[:2])
    serial = len(ranked)
    for _ in range(generations):
        if ranked[0][0][0] <= least:
            break
        first, second = (min(rng.integers(0, len(ranked), 2).tolist()) for _ in range(2))
        child = crossover(ranked[first][2], ranked[second][2], sizes, capacity, rng)
        child = mutated(child, sizes, capacity, rng)
        serial += 1
        ranked = sorted([*ranked, (score(child), serial, child)], key=lambda x: x[:2])[:len(population)]
    return [p for _, _, p in ranked]


def first_population(sizes: list[int], capacity: int, size: int, rng) -> list[list[list[int]]]:
    falling = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    least = -(-sum(sizes) // capacity)
    made = [best_fit(falling, sizes, capacity)]
    while len(made) < size and len(made[0]) > least:
        shift = np.array([sizes[i] for i in falling]) * rng.uniform(0.8, 1.0, len(falling))
        made.append(best_fit([falling[n] for n in np.argsort(-shift, kind="stable")], sizes, capacity))
    return made


# --- islands ------------------------------------------------------------------

def _labels(bins: list[list[int]], n: int) -> list[int]:
    out = np.zeros(n, np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out.tolist()


def _bins(labels: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(labels):
        out.setdefault(b, []).append(i)
    return [out[b] for b in sorted(out)]


_STATE = "block bigint, island int, rows array<bigint>, sizes array<int>, packings array<array<int>>, n_bins int, least int"


def _state(block, island, rows, sizes, capacity, packings):
    return {"block": block, "island": island, "rows": rows, "sizes": sizes,
            "packings": [_labels(p, len(sizes)) for p in packings], "n_bins": len(packings[0]),
            "least": -(-sum(sizes) // capacity)}


def _settle(capacity: int, population: int, seed: int):
    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                rows, sizes = [int(x) for x in r.rows], [int(x) for x in r.sizes]
                rng = np.random.default_rng([seed, int(r.block), int(r.island)])
                out.append(_state(r.block, r.island, rows, sizes, capacity,
                                  first_population(sizes, capacity, population, rng)))
            yield pd.DataFrame(out, columns=["block", "island", "rows", "sizes", "packings", "n_bins", "least"])
    return run


def _epoch(capacity: int, generations: int, seed: int, epoch: int):
    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                sizes = [int(x) for x in r.sizes]
                rng = np.random.default_rng([seed, epoch, int(r.block), int(r.island)])
                population = [_bins(list(p)) for p in r.packings]
                if r.guest is not None:  # the neighbour's best takes the place of the worst
                    population = [*population[:max(1, len(population) - 1)], _bins(list(r.guest))]
                out.append(_state(r.block, r.island, list(r.rows), sizes, capacity,
                                  evolve(sizes, capacity, population, generations, rng)))
            yield pd.DataFrame(out, columns=["block", "island", "rows", "sizes", "packings", "n_bins", "least"])
    return run


def sequences(cut: DataFrame, capacity: int = CAPACITY, block_size: int = 8192, islands: int = 3, population: int = 4,
              epochs: int = 2, generations: int = 8, seed: int = 7) -> DataFrame:
    """``cut`` (as ``pieces`` returns it, written) plus sequence_id and offset of every piece.

    Only blocks whose best packing may still be improved go through the
    epochs. An empty table gives an empty table.
    """
    full = cut.where(F.col("length") >= capacity)
    loose = cut.where(F.col("length") < capacity)
    n_blocks = max(1, -(-loose.count() // block_size))
    # A block's rows are bounded by block_size on average; their numbers are unique, so the hash spreads them evenly.
    blocks = (loose.select(F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block"),
                           F.struct("row", F.col("length").cast("int").alias("length")).alias("item"))
              .groupBy("block").agg(F.sort_array(F.collect_list("item")).alias("items"))
              .select("block", F.col("items.row").alias("rows"), F.col("items.length").alias("sizes")))
    start = blocks.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    state = write_scratch(start.repartition("block", "island").mapInPandas(_settle(capacity, population, seed), _STATE),
                          "islands")
    done = state.where("n_bins <= least").groupBy("block").agg(F.min_by(F.struct("rows", "sizes", "packings"), "island")
                                                               .alias("best"))
    results = [write_scratch(done.select("block", "best.*"), "packed")]
    for epoch in range(epochs):
        solved = state.where("n_bins <= least").select("block")
        open_ = state.join(solved, "block", "left_anti")
        guests = open_.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"),
                              F.col("packings")[0].alias("guest"))
        state = write_scratch(open_.join(guests, ["block", "island"], "left").repartition("block", "island")
                              .mapInPandas(_epoch(capacity, generations, seed, epoch), _STATE), "islands")
        last = epoch == epochs - 1
        ended = state if last else state.where("n_bins <= least")
        best = ended.groupBy("block").agg(F.min_by(F.struct("rows", "sizes", "packings"),
                                                   F.struct("n_bins", "island")).alias("best"))
        results.append(write_scratch(best.select("block", "best.*"), "packed"))
    packed = results[0]
    for more in results[1:]:
        packed = packed.unionByName(more)
    placed = packed.select("block", F.explode(F.arrays_zip("rows", F.col("packings")[0].alias("bin"))).alias("p")).select(
        F.col("p.rows").alias("row"), (F.col("block") * F.lit(1 << 24) + F.col("p.bin")).alias("sequence_id"))
    order = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    joined = loose.join(placed, "row").withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0).cast("bigint")))
    own = full.select(*columns, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return joined.select(*columns, "sequence_id", "offset").unionByName(own)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, **how) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    return sequences(pieces(docs, tokenizer_path, id_col, text_col, capacity), capacity, **how)
