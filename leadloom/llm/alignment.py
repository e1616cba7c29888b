"""Alignment of the tokens of two tokenizers by merge-path partitioning.

Tokenizer A is a byte-level BPE model, tokenizer B a SentencePiece model with
byte fallback. Both cut the same bytes (a blank and the text), so their token
ends are two sorted arrays. The path that merges them is cut by diagonals: a
binary search on each finds where it crosses, and the pieces between two
diagonals hold equal work and are merged independently. A piece emits the ends
that both arrays share; groups that go over a piece's border are stitched by
the last shared end before it.

Texts of a batch lie end to end in one pair of arrays (both tokenizers end
where a text ends), so a long text is cut into pieces like many short ones.
Tokens are made per unit: no token of either model reaches over a blank that
stands between two non-blanks, so ids of units are kept per worker.

Two tokens that end together are suffixes of one another. So the pairs that
can ever be linked follow from the two vocabularies alone (``PairTable``), and
corpus-wide counts are one number per such pair whatever the corpus holds.
"""

from __future__ import annotations

import re
from array import array
from hashlib import sha256
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.common import text_or_empty
from leadloom.llm.token_counts import RankMerges, windows
from leadloom.session import scratch_path

#: A blank between two non-blanks: no token of either model holds it behind another character.
_CUT = re.compile(r"(?<! ) (?=\S)")
_WORD, _LETTER = regex.compile(r"\p{L}+").fullmatch, regex.compile(r"\p{L}").fullmatch
_ENDED = regex.compile(r"(\p{L}{1,32})([!-/:-@\[-`{-~]{1,8})").fullmatch  # letters, then ASCII marks
_BLANK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_BATCH = 1 << 21  # characters aligned together
_NOTED = 64
_STEPS = 8192  # of the merge path per piece


# --- the merge path ---------------------------------------------------------------

def path_splits(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two sorted arrays crosses every ``work``-th diagonal: (elements of a, of b) before it.

    All diagonals are searched at once. Equal ends stay in one piece: if the
    last element of a before a diagonal equals the first of b behind it, the
    piece takes that one too.
    """
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(low), bool)
        first[open_] = a[middle[open_]] <= b[(diagonals - middle - 1)[open_]]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    i, j = low, diagonals - low
    inner = (i > 0) & (j < len(b))
    j = j.copy()
    j[inner] += a[i[inner] - 1] == b[j[inner]]
    return i, j


def piece_overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends that both parts of one piece hold."""
    at = np.searchsorted(b, a)
    shared = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a) if len(b) else np.zeros(0, np.int64)
    return shared, at[shared]


def shared_ends(a: np.ndarray, b: np.ndarray, work: int = _STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of all shared ends; piece by piece, each without the others."""
    i, j = path_splits(a, b, work)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i0, i1, j0, j1 in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist()):
        x, y = piece_overlaps(a[i0:i1], b[j0:j1])
        out_a.append(x + i0)
        out_b.append(y + j0)
    return np.concatenate(out_a), np.concatenate(out_b)


def stitched(places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(last of its group, group) of each of n tokens: what stands before a piece's first shared end goes on from the last."""
    ends = np.zeros(n, bool)
    ends[places] = True
    return ends, np.cumsum(ends) - ends


# --- tokens -----------------------------------------------------------------------

class TwoModels:
    """Ids of units in both models, kept up to a number and emptied when full."""

    def __init__(self, path_a: str, path_b: str, most: int = 500_000):
        from sentencepiece import SentencePieceProcessor

        self.merges = RankMerges(path_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        kinds = [self.b.IsControl(i) or self.b.IsUnknown(i) for i in range(self.b.vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(len(kinds))]
        if any(_BLANK in x.lstrip(_BLANK) for x, odd in zip(names, kinds) if not odd):
            raise ValueError("a piece of the second model holds a blank behind another character")
        if self.b.encode(" a  b ") == self.b.encode("a b") or self.b.decode(self.b.encode("a")) != "a":
            raise ValueError("the second model must keep white space")
        self.bytes_a = self.merges.bytes
        self.bytes_b = [b"" if odd else bytes([int(_BYTE.fullmatch(x)[1], 16)]) if self.b.IsByte(i)
                        else x.replace(_BLANK, " ").encode() for i, (x, odd) in enumerate(zip(names, kinds))]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # One string per token and place in its group: inside, or the last one.
        self.shown = [*(f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))),
                      *(f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b)))]
        self.most = most
        self.units_a: dict[str, bytes] = {}
        self.units_b: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.tails: dict[str, tuple[bytes, bytes]] = {}
        # What stands behind a letter in some piece; it can't be looked up apart from the letters.
        self.joined = {"\ufffd", _BLANK} | {y for x, odd in zip(names, kinds) if not odd for z, y in pairwise(x) if _LETTER(z)}
        self.pairs = PairTable(self.bytes_a, self.bytes_b)

    def learn(self, units: set[str]) -> None:
        """Ids of units; a unit is what follows a blank. Marks those that don't come back from their ids.

        Letters and the marks behind them are looked up apart, if no piece holds a letter before the first mark.
        """
        ended = {u: found.groups() for u in units if (found := _ENDED(u)) and found[2][0] not in self.joined}
        self._add({*(units - ended.keys()), *(core for core, _ in ended.values())} - self.units_a.keys())
        for tail in {tail for _, tail in ended.values()} - self.tails.keys():
            symbols, _ = self.merges.merged([p.encode() for p in self.merges.find(tail)])
            alone = self.b.encode("a" + tail)
            self.tails[tail] = symbols.astype("<i4").tobytes(), array("i", alone[len(self.b.encode("a")):]).tobytes()
        for u, (core, tail) in ended.items():
            a, b = self.tails[tail]
            self.units_a[u], self.units_b[u] = self.units_a[core] + a, self.units_b[core] + b
            if core in self.odd:
                self.odd.add(u)

    def _add(self, units: set[str]) -> None:
        if not units:
            return
        order = list(units)
        split = [[" " + u] if _WORD(u) else self.merges.find(" " + u) for u in order]
        wanted = list(set(chain.from_iterable(split)))
        symbols, sizes = self.merges.merged([p.encode() for p in wanted])
        data, ends = symbols.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        ids = dict(zip(wanted, (data[x:y] for x, y in zip([0, *ends], ends))))
        self.units_a.update((u, ids[found[0]] if len(found) == 1 else b"".join(map(ids.__getitem__, found)))
                            for u, found in zip(order, split))
        pieces = self.b.encode(order, num_threads=1)
        self.units_b.update((u, array("i", found).tobytes()) for u, found in zip(order, pieces))
        self.odd.update(u for u, found in zip(order, pieces)
                        if b"".join(map(self.bytes_b.__getitem__, found)) != b" " + u.encode())

    def forget(self, units: set[str]) -> None:
        """Make room: long units at once, all others when the table is full."""
        for u in [u for u in units if len(u) > _NOTED]:
            del self.units_a[u], self.units_b[u]
            self.odd.discard(u)
        if len(self.units_a) > self.most:
            self.units_a.clear()
            self.units_b.clear()
            self.odd.clear()
            self.tails.clear()

    def ids(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of both models per text, as little-endian 32-bit numbers; none if they don't give the text back."""
        split = []
        for text in texts:
            units = list(chain.from_iterable(map(_split, windows(" " + text, _CUT)))) if text else []
            split.append(units)
        new = set(chain.from_iterable(split)) - self.units_a.keys()
        self.learn(new)
        out_a, out_b = [], []
        for text, units in zip(texts, split):
            a, b = b"".join(map(self.units_a.__getitem__, units)), b"".join(map(self.units_b.__getitem__, units))
            if self.odd and not self.odd.isdisjoint(units):
                wanted = b" " + text.encode()
                same = all(b"".join(map(names.__getitem__, np.frombuffer(x, "<i4").tolist())) == wanted
                           for x, names in ((a, self.bytes_a), (b, self.bytes_b)))
                a, b = (a, b) if same else (b"", b"")
            out_a.append(a)
            out_b.append(b)
        self.forget(new)
        return out_a, out_b


def _split(window: str) -> list[str]:
    """Units of a window that starts with a blank, without the blank before each."""
    units = _CUT.split(window)
    if units[0] == "":
        return units[1:]
    units[0] = units[0][1:]
    return units


class PairTable:
    """All pairs (a, b) whose bytes are suffixes of one another: as many as follow from the vocabularies, no more."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.n_b = len(bytes_b)
        keys = {a * self.n_b + b for a, b in _suffixes(bytes_a, bytes_b)} | {a * self.n_b + b for b, a in _suffixes(bytes_b, bytes_a)}
        self.keys = np.sort(np.fromiter(keys, np.int64, len(keys)))

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) * self.n_b + b

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; quick for ascending keys."""
        return np.searchsorted(self.keys, keys).astype("<i4")

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Whether a pair's count is the highest of its b."""
        b = self.keys % self.n_b
        most = np.zeros(self.n_b, np.int64)
        np.maximum.at(most, b, counts)
        return counts == most[b]


def _suffixes(longer: list[bytes], shorter: list[bytes]):
    by: dict[bytes, list[int]] = {}
    for i, x in enumerate(shorter):
        if x:
            by.setdefault(x, []).append(i)
    for i, x in enumerate(longer):
        for k in range(len(x)):
            for j in by.get(x[k:], ()):
                yield i, j


_KEPT: dict[tuple[str, str], TwoModels] = {}


def two_models(path_a: str, path_b: str) -> TwoModels:
    """One per Python worker."""
    key = (path_a, path_b)
    if key not in _KEPT:
        _KEPT[key] = TwoModels(*key)
    return _KEPT[key]


# --- texts ------------------------------------------------------------------------

def aligned(models: TwoModels, texts: list[str], work: int = _STEPS) -> list[tuple]:
    """(n_a, n_b, n_groups, digest, links) per text; links: sorted 32-bit places in the pair table, as bytes."""
    ids_a, ids_b = models.ids(texts)
    n_a, n_b = (np.array([len(x) // 4 for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.frombuffer(b"".join(ids), "<i4") for ids in (ids_a, ids_b))
    last_a, last_b = shared_ends(np.cumsum(models.len_a[a]), np.cumsum(models.len_b[b]), work)
    linked = models.pairs.key(a[last_a], b[last_b])
    # Tokens in the order of the digest: a group's tokens of A, then those of B.
    (ends_a, group_a), (ends_b, group_b) = stitched(last_a, len(a)), stitched(last_b, len(b))
    codes = np.empty(len(a) + len(b), np.int64)
    before_b = np.concatenate([[0], last_b + 1])
    codes[np.arange(len(a)) + before_b[group_a]] = a + len(models.bytes_a) * ends_a
    codes[np.arange(len(b)) + (last_a + 1)[group_b]] = b + 2 * len(models.bytes_a) + len(models.bytes_b) * ends_b
    cut_a, cut_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
    cut_groups = np.searchsorted(last_a, cut_a - 1, side="right")
    out = []
    for k in range(len(texts)):
        if not n_a[k]:
            out.append((0, 0, 0, "", b""))
            continue
        g0, g1 = cut_groups[k], cut_groups[k + 1]
        begin, end = int(cut_a[k] + cut_b[k]), int(cut_a[k + 1] + cut_b[k + 1])
        digest = sha256()
        for at in range(begin, end, 1 << 20):
            part = "".join(map(models.shown.__getitem__, codes[at:min(end, at + (1 << 20))].tolist()))
            digest.update((part[:-1] if at + (1 << 20) >= end else part).encode())
        out.append((int(n_a[k]), int(n_b[k]), int(g1 - g0), digest.hexdigest(), models.pairs.index(np.sort(linked[g0:g1])).tobytes()))
    return out


def _slices(texts: list[str]):
    """Ranges of texts of a bounded number of characters; a longer text is a range of its own."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > _BATCH:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: list[str] = (),
          work: int = _STEPS) -> DataFrame:
    """``keep`` columns, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Null and empty texts, and texts whose tokens don't give a blank and the
    text back, have no tokens: zeros and an empty digest. Repeated rows get a
    row each and count as often; an empty table gives an empty table; columns
    that are not in ``keep`` go, whatever their names.

    Corpus-wide counts take one row per task and linked pair, and are handed
    to the workers as one array with a place for each pair of ``PairTable``
    (about 270,000 for the given files), whose size the vocabularies fix.
    """
    keep = list(keep)
    spark = docs.sparkSession
    packed = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in keep]).alias("kept"),
                         text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    kept_type = packed.schema["kept"].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "groups_sha256", "links"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def cut(batches):
        models = two_models(path_a, path_b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _slices(texts):
                columns = zip(*aligned(models, texts[begin:end], work))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=["kept", *names])

    made = packed.mapInArrow(cut, f"kept {kept_type}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary")
    path = scratch_path(spark, "aligned")
    made.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(made.schema).parquet(path)
    models = two_models(path_a, path_b)
    size = len(models.pairs.keys)

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            links = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(links, "<i4"), minlength=size)
        at = np.flatnonzero(total)
        for begin in range(0, len(at), 50_000):
            part = at[begin:begin + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["pair", "n"])

    found = made.select("links").mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    shared = spark.sparkContext.broadcast((counts, models.pairs.best(counts)))

    def weigh(batches):
        counts, best = shared.value
        for batch in batches:
            each = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (
                    [len(x) for x in each], [int(best[x].sum()) for x in each], [int(counts[x].sum()) for x in each]))],
                names=["kept", "n_links", "n_best", "count_sum"])

    rest = F.struct("kept", "n_a", "n_b", "n_groups", "groups_sha256").alias("kept")
    weighed = made.select(rest, "links").mapInArrow(
        weigh, f"kept struct<kept:{kept_type},n_a:bigint,n_b:bigint,n_groups:bigint,groups_sha256:string>, "
               "n_links bigint, n_best bigint, count_sum bigint")
    return weighed.select(*[F.col("kept.kept")[c].alias(c) for c in keep], "kept.n_a", "kept.n_b", "kept.n_groups",
                          "n_links", "n_best", "count_sum", "kept.groups_sha256")
