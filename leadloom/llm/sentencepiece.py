"""SentencePiece encoding by the model's own method, and decoding.

Blanks and line ends cut a text into units that no piece crosses, so each unit
is encoded on its own; results of frequent units are kept per worker.

A model of the BPE kind joins neighbouring pieces in the order of their ranks.
Every unit gets the library's own merge result; a giant text is cut into chunks
at unit borders. No merge crosses a border, so ids are those of the library.

For a model of the unigram kind a text's pieces are the segmentation with the
largest sum of piece scores, a max-plus problem (``Lattice``). A short text is
one dynamic program. A giant text is split into chunks. A boundary's state says how many characters
after the boundary the piece that crosses it ends (0: none crosses). Each
chunk gives a matrix of best scores from entry to exit state; max-plus
products of matrices are associative, so a tree of groups of chunks combines
them. The whole text enters and ends in state 0; going down the tree fixes the
states of all boundaries; then every chunk is traced back on its own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.common import text_or_empty
from leadloom.session import write_scratch

BLANK = "▁"
NEVER = -np.inf
MOST_UNITS = 1 << 16  # kept per worker, and as many of before; a long unit counts as one for each 64 characters begun
_UNITS = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n[^{BLANK}\n]*|[^{BLANK}\n]+")
_BORDER = re.compile(f"(?<!{BLANK}){BLANK}|\n")


class _Pieces:
    """Pieces and scores of a model file, with the ids of frequent units; ``learn`` and ``unit_ids`` are the method's."""

    def __init__(self, path: str, most_units: int = MOST_UNITS):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in normal}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        crossing = [p for p in self.pieces if (BLANK in p[1:] and p.strip(BLANK)) or ("\n" in p and len(p) > 1)]
        if crossing:
            raise ValueError("pieces that cross blanks or line ends are not supported")
        self.texts = [b""] * n
        for p, (i, _) in self.pieces.items():
            self.texts[i] = p.replace(BLANK, " ").encode()
        for b, i in self.bytes.items():
            self.texts[i] = bytes([b])
        self.most_units = most_units
        self.known = _Known(self)

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """``ids`` of some texts; their new units are learned together."""
        cut = [None if not t or _spaced(t) else t.replace("\n", " \n").split(" ") for t in texts]
        self.known.learn(set().union(*filter(None, cut)))
        return [b"".join(map(self.known.__getitem__, units)) if units else self.ids(t) for t, units in zip(texts, cut)]

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not text:
            return b""
        if _spaced(text):
            units = _UNITS.findall(BLANK + text.replace(" ", BLANK))
            return b"".join(map(self.known.by_unit, units))
        return b"".join(map(self.known.__getitem__, text.replace("\n", " \n").split(" ")))


class Merges(_Pieces):
    """A model of the BPE kind: every unit has the ids that the library's merges give."""

    def __init__(self, path: str, most_units: int = MOST_UNITS):
        super().__init__(path, most_units)
        # Units bring their own blank: a second normalizer_spec, merged into the first, has add_dummy_prefix (3) off.
        with open(path, "rb") as f:
            self.model.load_from_serialized_proto(f.read() + b"\x1a\x02\x18\x00")

    def learn(self, units: set[str]) -> tuple[dict[str, bytes], None]:
        """Ids of all units; merge results have no scores."""
        units = list(units)
        return dict(zip(units, (array("I", x).tobytes() for x in self.model.encode(units, num_threads=1)))), None

    def unit_ids(self, unit: str) -> bytes:
        return array("I", self.model.encode(unit)).tobytes()

    def cut_ids(self, s: str) -> bytes:
        """Ids of a chunk that starts at a unit border; ``s`` has its blanks as U+2581."""
        units = _UNITS.findall(s)
        self.known.learn({u[1:] if u[0] == BLANK else u for u in units if u[0] == "\n" or (u[0] == BLANK and u[1:2] != BLANK)})
        return b"".join(map(self.known.by_unit, units))


class Lattice(_Pieces):
    """Best segmentations by the sum of piece scores, as a model of the unigram kind has them."""

    def __init__(self, path: str, most_units: int = MOST_UNITS):
        super().__init__(path, most_units)
        model = self.model
        self.unknown = model.unk_id()
        self.unknown_score = min(s for _, s in self.pieces.values()) - 10
        self.longest = max(map(len, self.pieces))
        # A tree of characters: character -> (children, id or -1, score).
        self.tree: dict = {}
        for p, (i, score) in self.pieces.items():
            kids = self.tree
            for c in p[:-1]:
                kids = kids.setdefault(c, ({}, -1, 0.0))[0]
            kids[p[-1]] = (kids[p[-1]][0] if p[-1] in kids else {}, i, score)
        self._flatten()
        self.scores: dict[str, float] = {}

    def unit_ids(self, unit: str) -> bytes:
        return array("I", self.segment(unit)[0]).tobytes()

    def _flatten(self) -> None:
        """The tree as arrays: sorted (node, character) keys, the node each leads to, and every node's id and score."""
        edges, ids, scores, open_ = [], [-1], [0.0], [(0, self.tree)]
        while open_:
            node, kids = open_.pop()
            for c, (below, found, score) in kids.items():
                edges.append((node << 21 | ord(c), len(ids)))
                open_.append((len(ids), below))
                ids.append(found)
                scores.append(score)
        edges.sort()
        self.keys, self.leads = np.array([k for k, _ in edges]), np.array([n for _, n in edges])
        self.node_ids, self.node_scores = np.array(ids, np.int32), np.array(scores)

    def learn(self, units: set[str]) -> tuple[dict[str, bytes], dict[str, float]]:
        """Ids and scores of all units as by ``segment``, for all units of a length at once."""
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        all_ids, scores = {}, {}
        for size, same in by_length.items():
            if len(same) * 8 < size:  # few long units: one by one
                for u in same:
                    ids, scores[u] = self.segment(u)
                    all_ids[u] = array("I", ids).tobytes()
                continue
            step = max(1, (1 << 20) // size)
            for at in range(0, len(same), step):
                part = same[at:at + step]
                ids, best = self._same_length(part, size)
                all_ids.update(zip(part, ids))
                scores.update(zip(part, best))
        return all_ids, scores

    def _same_length(self, units: list[str], size: int) -> tuple[list[bytes], list[float]]:
        n = len(units)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<i4").reshape(n, size).T.astype(np.int64)
        best = np.full((size + 1, n), NEVER)
        back, ids = np.zeros((size + 1, n), np.int32), np.full((size + 1, n), -1, np.int32)
        best[0] = 0.0
        for i in range(size):
            rows, node = np.arange(n), np.zeros(n, np.int64)
            lone = best[i] + self.unknown_score  # only where the character is no piece
            for j in range(i, min(size, i + self.longest)):
                wanted = node << 21 | codes[j][rows]
                at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                there = self.keys[at] == wanted
                rows, node = rows[there], self.leads[at[there]]
                ends = self.node_ids[node] >= 0
                r, to = rows[ends], node[ends]
                if j == i:
                    lone[r] = NEVER
                    worse = lone > best[i + 1]
                    best[i + 1][worse], back[i + 1][worse], ids[i + 1][worse] = lone[worse], i, -1
                score = best[i][r] + self.node_scores[to]
                better = score > best[j + 1][r]
                r = r[better]
                best[j + 1][r], back[j + 1][r], ids[j + 1][r] = score[better], i, self.node_ids[to[better]]
                if not len(rows):
                    break
        way, count, at, rows = np.zeros((n, size), "<u4"), np.zeros(n, np.int64), np.full(n, size), np.arange(n)
        plain = np.ones(n, bool)
        for k in range(size - 1, -1, -1):
            found = ids[at, rows]
            plain[rows[found < 0]] = False
            way[rows, k] = found
            count[rows] += 1
            at = back[at, rows]
            rows, at = rows[at > 0], at[at > 0]
            if not len(rows):
                break
        data, stops = way.tobytes(), (np.arange(1, n + 1) * size * 4)
        found = [data[a:b] for a, b in zip((stops - 4 * count).tolist(), stops.tolist())]
        for k in np.flatnonzero(~plain).tolist():  # characters without a piece
            found[k] = array("I", self.segment(units[k])[0]).tobytes()
        return found, best[size].tolist()

    def matches(self, s: str, i: int) -> list[tuple[int, float]]:
        """(end, score) of every piece at i; an unknown character is a piece of its own."""
        out, kids = [], self.tree
        for j in range(i, len(s)):
            node = kids.get(s[j])
            if node is None:
                break
            kids, found, score = node
            if found >= 0:
                out.append((j + 1, score))
        return out if out and out[0][0] == i + 1 else [(i + 1, self.unknown_score), *out]

    def ids_of(self, token: str) -> list[int]:
        found = self.pieces.get(token)
        if found:
            return [found[0]]
        return [self.bytes[b] for b in token.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def segment(self, s: str, start: int = 0, end: int | None = None, before: int | None = None) -> tuple[list[int], float]:
        """Ids and score of the best way from ``start`` to ``end``; no piece but the last reaches ``before``.

        Of equal scores the way whose last piece is longest wins.
        """
        end = len(s) if end is None else end
        before = end if before is None else before
        best, back, ids = [NEVER] * (end + 1), [-1] * (end + 1), [-1] * (end + 1)
        best[start] = 0.0
        tree, most = self.tree, self.longest
        for i in range(start, min(before, end)):
            so_far, j, kids = best[i], i, tree
            if so_far == NEVER:
                continue
            node = tree.get(s[i])
            if (node is None or node[1] < 0) and so_far + self.unknown_score > best[i + 1]:
                best[i + 1], back[i + 1], ids[i + 1] = so_far + self.unknown_score, i, -1
            for c in s[i:min(end, i + most)]:
                node = kids.get(c)
                if node is None:
                    break
                j += 1
                kids, found, score = node
                if found >= 0 and so_far + score > best[j]:
                    best[j], back[j], ids[j] = so_far + score, i, found
        way, at = [], end
        while at > start:
            way.append(ids[at] if ids[at] >= 0 else self.ids_of(s[at - 1])[::-1])
            at = back[at]
        way.reverse()
        return [x for w in way for x in (reversed(w) if isinstance(w, list) else (w,))], best[end]

    def total(self, units: list[str]) -> float:
        """Sum of the best scores of some units."""
        new = {u for u in units if u not in self.scores}
        if len(self.scores) + len(new) > self.most_units:
            self.scores.clear()
            new = set(units)
        self.scores.update(self.learn(new)[1])
        return sum(map(self.scores.__getitem__, units))

    # --- chunks

    def matrix(self, s: str, size: int) -> np.ndarray:
        """Best scores [entry, exit] of a chunk of ``size`` characters; ``s`` goes on past its end by the overlap."""
        n = self.longest
        out = np.full((n, n), NEVER)
        cuts = [i for i in range(1, size + 1) if i < len(s) and ((s[i] == BLANK and s[i - 1] != BLANK) or s[i] == "\n")]
        inner = [i for i in cuts if i >= n - 1]
        if not inner:
            for entry in range(min(n, size + 1)):
                out[entry] = self._ends(s, entry, size)
            # A piece that crosses the whole chunk is not possible: chunks are longer than the longest piece.
            return out
        first, last = inner[0], inner[-1]
        ways = [NEVER] * (first + 1)
        ways[first] = 0.0
        for i in range(first - 1, -1, -1):
            ways[i] = max((score + ways[j] for j, score in self.matches(s, i) if j <= first), default=NEVER)
        middle = self.total([s[a:b] for a, b in zip(inner, inner[1:])])
        return np.array(ways[:n])[:, None] + middle + self._ends(s, last, size)[None, :]

    def _ends(self, s: str, start: int, size: int) -> np.ndarray:
        best = [NEVER] * (size + self.longest)
        best[start] = 0.0
        for i in range(start, size):
            if best[i] > NEVER:
                for j, score in self.matches(s, i):
                    best[j] = max(best[j], best[i] + score)
        return np.array(best[size:size + self.longest])

    def traced(self, s: str, size: int, entry: int, leave: int) -> bytes:
        """Ids of a chunk between two boundary states."""
        end = size + leave
        cuts = [i for i in range(max(1, entry), size + 1)
                if i < len(s) and ((s[i] == BLANK and s[i - 1] != BLANK) or s[i] == "\n")]
        if not cuts:
            return array("I", self.segment(s, entry, end, size)[0]).tobytes()
        head = array("I", self.segment(s[:cuts[0]], entry)[0]).tobytes()
        tail = array("I", self.segment(s, cuts[-1], end, size)[0]).tobytes()
        units = [s[a:b] for a, b in zip(cuts, cuts[1:])]
        self.known.learn({u[1:] if u[0] == BLANK else u for u in units if u[:2] != BLANK * 2})
        return head + b"".join(map(self.known.by_unit, units)) + tail


def _spaced(text: str) -> bool:
    """Whether units may begin with several blanks."""
    return "  " in text or text[:1] == " " or BLANK in text


class _Known(dict):
    """Text between blanks -> ids. A key has no blank in front; one that starts with a line end has none in the text."""

    def __init__(self, pieces: _Pieces):
        super().__init__()
        self.pieces = pieces
        self.older: dict[str, bytes] = {}
        self.held = 0

    def learn(self, keys: set[str]) -> None:
        """Add all keys. When full, what was used since the last time stays at hand, the rest goes."""
        if self.held >= self.pieces.most_units:
            self.older = dict(self)
            self.clear()
            self.held = 0
        units = {}
        for key in keys.difference(self):
            self.held += 1 + len(key) // 64
            if key in self.older:
                self[key] = self.older[key]
            else:
                units[key if key.startswith("\n") else BLANK + key] = key
        ids, _ = self.pieces.learn(units.keys())
        self.update(zip(map(units.__getitem__, ids), ids.values()))

    def __missing__(self, key: str) -> bytes:
        self.learn({key})
        return self[key]

    def by_unit(self, unit: str) -> bytes:
        if unit[0] == BLANK and unit[1:2] != BLANK:
            return self[unit[1:]]
        if unit[0] == "\n":
            return self[unit]
        return self.pieces.unit_ids(unit)


_KEPT: dict[str, Merges | Lattice] = {}
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of every field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            value = data[at:at + size]
            at += size
        yield key >> 3, value


def kind_of(path: str) -> int:
    """``model_type`` (3) of the ``trainer_spec`` (2) of a model file; unigram if none is given."""
    with open(path, "rb") as f:
        spec = next((v for n, v in _fields(f.read()) if n == 2), b"")
    return next((v for n, v in _fields(spec) if n == 3), UNIGRAM)


def pieces_of(path: str) -> Merges | Lattice:
    """One per Python worker, by the method of the model's kind."""
    if path not in _KEPT:
        kind = kind_of(path)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only models of the unigram and BPE kinds are supported")
        _KEPT[path] = Merges(path) if kind == BPE else Lattice(path)
    return _KEPT[path]


def _through(matrices: list[np.ndarray], entry: int, leave: int) -> list[tuple[int, int]]:
    """(entry, exit) state of each chunk of a run whose outer states are known."""
    ways = [np.full(len(matrices[0]), NEVER)]
    ways[0][entry] = 0.0
    for m in matrices:
        ways.append((ways[-1][:, None] + m).max(axis=0))
    out, at = [], leave
    for k in range(len(matrices) - 1, -1, -1):
        before = int((ways[k] + matrices[k][:, at]).argmax())
        out.append((before, at))
        at = before
    return out[::-1]


def _product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None, :, :]).max(axis=1)
    return out


def _square(flat) -> np.ndarray:
    n = int(len(flat) ** 0.5)
    return np.array(flat).reshape(n, n)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] = (), chunk_chars: int = 1 << 15,
           group: int = 64) -> DataFrame:
    """``keep`` columns and ids (array<int>) of every row.

    Null and empty texts have no ids; repeated rows get a row each; an empty
    table gives an empty table. Texts of more than ``chunk_chars`` characters
    go through chunks: with the same ids for a model of the BPE kind, with the
    same scores for one of the unigram kind, where of equally good
    segmentations the chosen one may differ.
    """
    keep = list(keep)
    packed = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in keep]).alias("kept"),
                         text_or_empty(F.col(text_col)).alias("text"))
    names = [F.col("kept")[c].alias(c) for c in keep]
    short = packed.where(F.length("text") <= chunk_chars)
    kept_type = packed.schema["kept"].dataType.simpleString()

    def plain(batches):
        model = pieces_of(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                found = model.all_ids(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(found)], names=["kept", "ids"])

    done = short.mapInArrow(plain, f"kept {kept_type}, ids array<int>")
    giants = write_scratch(packed.where(F.length("text") > chunk_chars)
                           .withColumn("row", F.monotonically_increasing_id()), "giants")
    if giants.isEmpty():
        return done.select(*names, "ids")
    rows = giants.select("row", "text")
    ids = (_encode_cut(rows, model_path, chunk_chars) if kind_of(model_path) == BPE
           else _encode_chunks(rows, model_path, chunk_chars, group))
    return done.unionByName(giants.select("row", "kept").join(ids, "row").select("kept", "ids")).select(*names, "ids")


def _lists(found: list[bytes]) -> pa.ListArray:
    sizes = np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(found), "<i4")))


def chunks_at_units(s: str, chunk_chars: int) -> Iterator[str]:
    """Parts of at least ``chunk_chars`` characters (but the last) that end at unit borders."""
    at = 0
    while at < len(s):
        found = _BORDER.search(s, at + chunk_chars)
        end = found.start() if found else len(s)
        yield s[at:end]
        at = end


def _encode_cut(giants: DataFrame, model_path: str, chunk_chars: int) -> DataFrame:
    """(row, ids) of giant texts, cut at unit borders."""
    def cut(frames):
        for frame in frames:
            for row, text in zip(frame.row, frame.text):
                for i, s in enumerate(chunks_at_units(BLANK + text.replace(" ", BLANK), chunk_chars)):
                    yield pd.DataFrame({"row": [row], "i": [i], "s": [s]})

    def run(frames):
        model = pieces_of(model_path)
        for frame in frames:
            yield pd.DataFrame({"row": frame.row, "i": frame.i, "ids": [np.frombuffer(model.cut_ids(s), "<i4") for s in frame.s]})

    chunks = write_scratch(giants.mapInPandas(cut, "row bigint, i bigint, s string"), "chunks")
    return _joined(chunks.repartition("row", "i").mapInPandas(run, "row bigint, i bigint, ids array<int>"))


def _joined(parts: DataFrame) -> DataFrame:
    """(row, ids) from the ids of all chunks (row, i, ids)."""
    return parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("parts")).select(
        "row", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def _encode_chunks(giants: DataFrame, model_path: str, chunk_chars: int, group: int) -> DataFrame:
    """(row, ids) of giant texts."""
    def cut(frames):
        over = pieces_of(model_path).longest
        for frame in frames:
            for row, text in zip(frame.row, frame.text):
                s = BLANK + text.replace(" ", BLANK)
                starts = list(range(0, len(s), chunk_chars))
                if len(starts) > 1 and len(s) - starts[-1] < over:
                    starts.pop()  # the last chunk is never shorter than a piece
                for i, at in enumerate(starts):
                    size = (starts[i + 1] if i + 1 < len(starts) else len(s)) - at
                    yield pd.DataFrame({"row": [row], "i": [i], "size": [size], "s": [s[at:at + size + over - 1]]})

    def matrices(frames):
        model = pieces_of(model_path)
        for frame in frames:
            yield pd.DataFrame({"row": frame.row, "i": frame.i, "m": [
                model.matrix(s, size).ravel() for s, size in zip(frame.s, frame["size"])]})

    def combine(frame):
        frame = frame.sort_values("i")
        m = _product([_square(x) for x in frame.m])
        return pd.DataFrame({"row": [frame.row.iloc[0]], "i": [frame.i.iloc[0] // group], "m": [m.ravel()]})

    def descend(frame):
        frame = frame.sort_values("i")
        states = _through([_square(x) for x in frame.m], int(frame.entry.iloc[0]), int(frame.leave.iloc[0]))
        return pd.DataFrame({"row": frame.row.values, "i": frame.i.values, "entry": [a for a, _ in states],
                             "leave": [b for _, b in states]})

    def trace(frames):
        model = pieces_of(model_path)
        for frame in frames:
            ids = [np.frombuffer(model.traced(s, size, a, b), "<i4") for s, size, a, b in
                   zip(frame.s, frame["size"], frame.entry, frame.leave)]
            yield pd.DataFrame({"row": frame.row, "i": frame.i, "ids": ids})

    chunks = write_scratch(giants.mapInPandas(cut, "row bigint, i bigint, size bigint, s string"), "chunks")
    levels = [write_scratch(chunks.repartition("row", "i").mapInPandas(matrices, "row bigint, i bigint, m array<double>"),
                            "matrices")]
    most = chunks.agg(F.max("i")).first()[0]
    while most > 0:
        up = F.floor(F.col("i") / group).alias("up")
        levels.append(write_scratch(levels[-1].groupBy("row", up).applyInPandas(
            combine, "row bigint, i bigint, m array<double>"), "matrices"))
        most //= group
    states = levels[-1].select("row", "i", F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for level in reversed(levels[:-1]):
        outer = states.withColumnRenamed("i", "up")
        inner = level.withColumn("up", F.floor(F.col("i") / group)).join(outer, ["row", "up"])
        states = write_scratch(inner.groupBy("row", "up").applyInPandas(
            descend, "row bigint, i bigint, entry int, leave int"), "states")
    return _joined(chunks.join(states, ["row", "i"]).mapInPandas(trace, "row bigint, i bigint, ids array<int>"))


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", keep: list[str] = ()) -> DataFrame:
    """``keep`` columns and text of every row. Null ids give an empty text; control pieces have no text.

    Decoding undoes ``encode`` exactly, but for the character U+2581, which stands for a blank.
    """
    keep = list(keep)
    packed = encoded.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in keep]).alias("kept"),
                            F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kept_type = packed.schema["kept"].dataType.simpleString()

    def run(batches):
        texts = pa.array(pieces_of(model_path).texts, pa.large_binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(1)
                # The pieces of all rows one after another are their bytes in one buffer; rows are cut out of it.
                taken = texts.take(ids.flatten())
                _, places, data = taken.buffers()
                places = np.frombuffer(places, np.int64) if len(taken) else np.zeros(1, np.int64)
                data = data.to_pybytes() if data else b""
                ends = places[np.cumsum([0, *ids.value_lengths().to_pylist()])].tolist()
                found = [data[a:b] for a, b in zip(ends, ends[1:])]
                found = [(f[1:] if f[:1] == b" " else f).decode("utf-8", "replace") for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], names=["kept", "text"])

    return packed.mapInArrow(run, f"kept {kept_type}, text string").select(
        *[F.col("kept")[c].alias(c) for c in keep], "text")
