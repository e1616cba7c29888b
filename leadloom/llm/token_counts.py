"""Token counts of a byte-level BPE model by rank-synchronous array merging.

A text falls into units (a word with the blank before it), a unit into
pre-tokens. New pre-tokens of a batch are held as one ragged numpy array of
symbols. In every round each sequence finds the lowest rank among its
neighbouring pairs, and all occurrences of that pair are merged in all
sequences at once; what is left in the end are the tokens. Counts of units are
kept per Python worker up to a fixed number.

Merging all occurrences of the lowest pair at once equals merging them one by
one if a merged symbol is made by one pair only and later than its parts;
model files for which that doesn't hold are refused.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.common import text_or_empty

#: Fixed value: the public pre-token pattern of byte-level BPE models with ``use_regex``.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank before a non-blank always starts a pre-token, whatever stands before it.
_CUT = re.compile(r" (?=\S)")
WINDOW = 1 << 20
NEVER = np.int32(2**31 - 1)
_WORD = regex.compile(r"\p{L}+").fullmatch
_NOTED = 64  # characters of the longest unit that is kept


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be printed, else one from 256 on."""
    out, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


def windows(text: str, cut: re.Pattern, size: int = WINDOW) -> Iterator[str]:
    """Parts of a text that start at matches of ``cut`` (but the first), of at least ``size`` characters (but the last)."""
    at = 0
    while at < len(text):
        found = cut.search(text, at + size) if len(text) - at > size else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


class RankMerges:
    """The merge table of a byte-level BPE model file."""

    def __init__(self, path: str, longest_round: int = 512):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not (model["type"] == "BPE" and plain and spec["normalizer"] is None and before.get("type") == "ByteLevel"
                and before.get("use_regex") and not before.get("add_prefix_space")):
            raise ValueError("only byte-level BPE models with the usual pre-tokens and no normalizer are supported")
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in what stands beside them are not supported")
        letters, vocab = byte_letters(), model["vocab"]
        self.first = np.array([vocab[c] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in part], np.int64) for part in (
            [a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        born = np.full(max(vocab.values()) + 1, NEVER, np.int64)
        born[made] = np.arange(len(made))
        born[self.first] = -1
        if len(set(made.tolist())) != len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("a symbol is made by two pairs or before its parts")
        self.base = len(born)
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)
        back = {c: b for b, c in enumerate(letters)}
        self.bytes = [b""] * self.base
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes[i] = bytes(back[c] for c in token)
        self.longest_round = longest_round
        self.find = regex.compile(PRE_TOKEN).findall

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NEVER for pairs that aren't merged."""
        wanted = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER)

    def merged(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all sequences in order, their number per sequence)."""
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        symbols = self.first[np.frombuffer(b"".join(sequences), np.uint8)]
        giants = np.flatnonzero(sizes > self.longest_round)
        if not len(giants):
            return self._rounds(symbols, sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out, at = [], 0
        for g in [*giants.tolist(), len(sizes)]:
            out.append(self._rounds(symbols[starts[at]:starts[g]], sizes[at:g]))
            if g < len(sizes):
                one = self._long(symbols[starts[g]:starts[g + 1]])
                out.append((one, np.array([len(one)])))
            at = g + 1
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])

    def _rounds(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All sequences together, one merge rank per sequence and round. Sequences that are done leave the array."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            ranks = np.full(len(symbols), NEVER, np.int32)
            inner = owner[:-1] == owner[1:]
            ranks[:-1][inner] = self.rank(symbols[:-1][inner], symbols[1:][inner])
            heads = np.flatnonzero(np.concatenate([[True], ~inner]))
            lengths = np.diff(np.append(heads, len(symbols)))
            least = np.repeat(np.minimum.reduceat(ranks, heads), lengths)
            going = least < NEVER
            if not going.all():
                done.append((owner[~going], symbols[~going]))
                owner, symbols, ranks, least = owner[going], symbols[going], ranks[going], least[going]
                if not len(symbols):
                    break
            at = _apart(np.flatnonzero(ranks == least))
            symbols = symbols.copy()
            symbols[at] = self.made[ranks[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            owner, symbols = owner[stays], symbols[stays]
        if not done:
            return symbols, np.zeros(len(sizes), np.int64)
        owners, found = (np.concatenate(x) for x in zip(*done))
        return found[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(sizes))

    def _long(self, symbols: np.ndarray) -> np.ndarray:
        """One long sequence: the same rounds, but each touches only the places of its rank."""
        n = len(symbols)
        symbols = symbols.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = np.append(self.rank(symbols[:-1], symbols[1:]), NEVER)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[ranks[at] < NEVER]
            at = at[np.argsort(ranks[at], kind="stable")]
            values, starts = np.unique(ranks[at], return_index=True)
            for r, part in zip(values.tolist(), np.split(at, starts[1:])):
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(part)

        note(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[ranks[at] == r]
            if not len(at):
                continue
            at = _apart(at, after)
            gone = after[at]
            symbols[at] = self.made[r]
            ranks[gone] = NEVER
            symbols[gone] = -1
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            touched = np.unique(np.concatenate([at, before[at]]))
            touched = touched[touched >= 0]
            following = after[touched]
            ranks[touched] = np.where(following < n, self.rank(symbols[touched], symbols[np.minimum(following, n - 1)]), NEVER)
            note(touched)
        return symbols[symbols >= 0]


def _apart(at: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Of overlapping places (a a a holds the pair twice) every second one stays, from the left."""
    follows = np.zeros(len(at), bool)
    follows[1:] = at[1:] == (at[:-1] + 1 if after is None else after[at[:-1]])
    i = np.arange(len(at))
    return at[(i - np.maximum.accumulate(np.where(follows, 0, i))) % 2 == 0]


class UnitCounts(dict):
    """Unit without its leading blank -> number of tokens; learnt a batch at a time and emptied when full."""

    def __init__(self, path: str, most: int = 400_000):
        super().__init__()
        self.merges = RankMerges(path)
        self.most = most
        self.pre_tokens: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.long: list[tuple[dict, str]] = []
        special = self.merges.special
        self.parts = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def learn(self, units: set[str], heads: set[str]) -> None:
        """Counts of new units and heads. A unit of letters only is a pre-token as it stands; others are put together."""
        words = {u for u in units if _WORD(u)}
        mixed = {u: self.merges.find(" " + u) for u in units - words}
        first = {h: self.merges.find(h) for h in heads}
        needed = set(chain.from_iterable(chain(mixed.values(), first.values())))
        spaced = {p: p[1:] for p in needed if p[0] == " " and _WORD(p[1:])}
        words = list(words.union(spaced.values()) - self.keys())
        others = list(needed - spaced.keys() - self.pre_tokens.keys())
        counts = self.merges.merged([*(b" " + u.encode() for u in words), *(p.encode() for p in others)])[1].tolist()
        self.update(zip(words, counts))
        self.pre_tokens.update(zip(others, counts[len(words):]))
        of = {p: self[spaced[p]] if p in spaced else self.pre_tokens[p] for p in needed}.__getitem__
        self.update((u, sum(map(of, found))) for u, found in mixed.items())
        self.heads.update((h, sum(map(of, found))) for h, found in first.items())
        for table, keys in ((self, units), (self, words), (self.pre_tokens, others), (self.heads, heads)):
            self.long += [(table, k) for k in keys if len(k) > _NOTED]

    def tidy(self) -> None:
        """Empty full tables; forget the long entries of the last batch."""
        for table in (self, self.pre_tokens, self.heads):
            if len(table) > self.most:
                table.clear()
        for table, key in self.long:
            table.pop(key, None)
        self.long.clear()

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of every text. Strings of added tokens count as one each."""
        out = [0] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for i, text in enumerate(texts):
            parts = self.parts.split(text) if self.parts else [text]
            out[i] += len(parts) - 1
            for piece in chain.from_iterable(windows(part, _CUT) for part in parts):
                waiting.append((i, _CUT.split(piece)))
                held += len(piece)
                if held >= WINDOW:
                    self._settle(waiting, out)
                    waiting, held = [], 0
        self._settle(waiting, out)
        return out

    def _settle(self, waiting: list[tuple[int, list[str]]], out: list[int]) -> None:
        """Add the counts of split texts: the head, which has no blank before it, then units."""
        heads = {units[0] for _, units in waiting} - self.heads.keys()
        new = set(chain.from_iterable(units[1:] for _, units in waiting)) - self.keys()
        if new or heads:
            self.learn(new, heads)
        for i, units in waiting:
            out[i] += self.heads[units[0]] + sum(map(self.__getitem__, units[1:]))
        self.tidy()


_KEPT: dict[str, UnitCounts] = {}


def counts_of(path: str) -> UnitCounts:
    """One table per Python worker."""
    if path not in _KEPT:
        _KEPT[path] = UnitCounts(path)
    return _KEPT[path]


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] = (), limit: int = 512) -> DataFrame:
    """``keep`` columns, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row.

    Null and empty texts have no bytes and no tokens; repeated rows get a row
    each; an empty table gives an empty table; columns that are not in ``keep``
    go, whatever their names. Texts of any length are counted whole, a window
    of about a megabyte at a time; a run without blanks is one window.
    """
    keep = list(keep)
    packed = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in keep]).alias("kept"),
                         text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    kept_type = packed.schema["kept"].dataType.simpleString()

    def run(batches):
        counts = counts_of(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = pa.array(counts.totals(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["kept", "n_tokens"])

    sized = packed.select(F.struct(F.col("kept"), F.octet_length("text").cast("bigint").alias("n_bytes")).alias("kept"), "text")
    counted = sized.mapInArrow(run, f"kept struct<kept:{kept_type},n_bytes:bigint>, n_tokens bigint")
    return counted.select(*[F.col("kept.kept")[c].alias(c) for c in keep], F.col("kept.n_bytes").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
