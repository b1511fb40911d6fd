"""SentencePiece encoding and decoding by a max-plus parallel scan over chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, giving_back, materialise, small_batches, worker_cache

SPACE = "▁"
#: Code points of a chunk; how far a cut may move to a place that no piece crosses.
CHUNK, SOFT = 32_768, 1_024
#: Chunks, or nodes of the tree above them, that one task combines.
FAN = 64
#: Distinct segments, in each of two generations, and pairs of pieces, that a worker remembers.
SEGMENTS, PAIRS = 250_000, 500_000
NEVER = float("-inf")

State = tuple[int, str]


class PieceCodec:
    """The pieces of a BPE model with byte fallback, and which of them can stand side by side.

    A sequence of pieces is the encoder's if each pair of neighbours is what it makes of their joint text. So
    the encoding is a path through (position, last piece): in max-plus terms an allowed pair weighs its
    piece's count, any other pair minus infinity. No piece holds a space after another character or a line end, so
    segments between these are independent, and a place between segments has a single state.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kinds = [(i, sp.id_to_piece(i)) for i in range(n)]
        self.ids = {p: i for i, p in kinds if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.rank = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, p in kinds if sp.is_byte(i)}
        plain = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes_of = [plain.get(i, b" \xe2\x81\x87 " if sp.is_unknown(i) else b"") for i in range(n)]
        self.longest = max(map(len, self.ids))
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces of this model cross spaces or line ends")
        self.follow: dict[str, dict[str, bool]] = {"": {}}
        self.known = 0
        self.segments = Remembered(self.encode_segment, SEGMENTS)
        self.segment = self._pattern()

    def _pattern(self) -> re.Pattern:
        """Segments between places that no piece crosses: spaces, line ends, and marks that no piece joins to a letter before."""
        pairs = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        marks = "".join(c for c in ".,;:!?" if not any(x.isalpha() and y == c for x, y in pairs))
        plain = f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n"
        return re.compile(f"{SPACE}?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[{marks}])|{plain}" if marks else plain)

    def fits(self, left: str, right: str) -> bool:
        """Whether the encoder leaves left + right as these two; characters without a piece stand alone."""
        if right not in self.ids and len(right) > 1:
            return False
        parts = [*left, *right]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts == ([left, right] if left else [right])

    def walk(self, text: str, start: int, last: str) -> tuple[list[str | None], list[int]]:
        """From a state at ``start``: for each later position the one piece that can end there, and where it begins."""
        n, longest, follow = len(text), self.longest, self.follow
        pieces: list[str | None] = [None] * (n + 1)
        begins = [-1] * (n + 1)
        tables: list[dict | None] = [None] * (n + 1)
        pieces[start], tables[start] = last, follow.setdefault(last, {})
        for i in range(start + 1, n + 1):
            for j in range(i - 1, max(start, i - longest) - 1, -1):
                table = tables[j]
                if table is None:
                    continue
                piece = text[j:i]
                fit = table.get(piece)
                if fit is None:
                    fit = table[piece] = self.fits(pieces[j], piece)
                    self.known += 1
                if fit:
                    pieces[i], begins[i], tables[i] = piece, j, follow.setdefault(piece, {})
                    break
        return pieces, begins

    def trace(self, pieces: list[str | None], begins: list[int], start: int, stop: int) -> list[int]:
        """Ids of the path that ends at ``stop``."""
        path = []
        while stop > start:
            path.append(self.ids.get(pieces[stop], pieces[stop]))
            stop = begins[stop]
        path.reverse()
        if str in map(type, path):
            return [i for p in path for i in ([self.byte[b] for b in p.encode()] if isinstance(p, str) else [p])]
        return path

    def encode_segment(self, segment: str) -> tuple[int, ...]:
        """The walk from a segment's start, where some piece can always end; back along it for the ids."""
        follow, longest = self.follow, self.longest
        pieces, begins, tables = [""], [0], [follow[""]]
        for i in range(1, len(segment) + 1):
            for j in range(i - 1, max(-1, i - longest - 1), -1):
                piece = segment[j:i]
                fit = tables[j].get(piece)
                if fit is None:
                    fit = tables[j][piece] = self.fits(pieces[j], piece)
                    self.known += 1
                if fit:
                    break
            else:
                raise ValueError(f"no pieces for {segment[:i]!r}")
            pieces.append(piece)
            begins.append(j)
            tables.append(follow.setdefault(piece, {}))
        return tuple(self.trace(pieces, begins, 0, len(segment)))

    def encode(self, escaped: str) -> list[int]:
        return list(chain.from_iterable(map(self.segments.__getitem__, self.segment.findall(escaped))))

    def forget(self) -> None:
        self.segments.forget()
        if self.known > PAIRS:
            self.follow, self.known = {"": {}}, 0

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def states(self, left: str, right: str) -> list[State]:
        """Where the piece that reaches the cut between left and right may end, and which piece it may be."""
        joint, cut = left[-self.longest :] + right[: self.longest - 1], min(len(left), self.longest)
        found = []
        for over in range(min(len(right), self.longest - 1) + 1):
            stop = cut + over
            for start in range(max(0, stop - self.longest), cut):
                if joint[start:stop] in self.ids or (over == 0 and start == cut - 1):
                    found.append((over, joint[start:stop]))
        return found


def codec(path: str) -> PieceCodec:
    """One per worker process, kept from task to task."""
    return worker_cache(("piece codec", path), lambda: PieceCodec(path))


def escape(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _soft(text: str, at: int) -> bool:
    """Whether no piece crosses position ``at``."""
    return at in (0, len(text)) or text[at - 1] == "\n" or text[at] == "\n" or (text[at] == SPACE and text[at - 1] != SPACE)


def cut_places(text: str, chunk: int = CHUNK, soft: int = SOFT) -> list[int]:
    """Where to cut: about every ``chunk`` characters, at a free place within ``soft`` of there if any.

    A chunk must be longer than any piece, so that no piece spans three.
    """
    soft = min(soft, chunk // 2)
    places = [0]
    for at in range(chunk, len(text), chunk):
        free = next((x for x in range(at, max(places[-1], at - soft), -1) if _soft(text, x)), at)
        places.append(free)
    return [*places, len(text)]


def _ends(text: str, soft_end: bool, stop: int, states: list[State], pieces: list[str | None]) -> list[bool]:
    if soft_end:
        return [pieces[stop] is not None]
    return [pieces[stop + over] == piece for over, piece in states]


class Chunk:
    """One chunk of an escaped text with what it must see of its neighbours; ``inner``: its inner ids, where they are known already."""

    def __init__(self, code: PieceCodec, left: str, body: str, right: str, soft_left: bool, soft_right: bool, inner: list[int] | None = None):
        self.code, self.body, self.stop, self.known = code, body, len(body), inner
        self.text = body if soft_right else body + right[: code.longest - 1]
        self.soft_right = soft_right
        self.entries: list[State] = [(0, "")] if soft_left else code.states(left, body + right)
        self.exits: list[State] = [(0, "")] if soft_right else code.states(left + body, right)
        free = [x for x in range(1, self.stop) if _soft(body, x)] if not (soft_left and soft_right) else [0, self.stop]
        #: Free places: up to the first the entries differ, from the last on the exits do. None at all, and the whole chunk is walked.
        self.first, self.last = (0 if soft_left else free[0], self.stop if soft_right else free[-1]) if free else (None, None)

    def inner(self) -> list[int]:
        """Ids between the first and the last free place, which no state at the ends changes."""
        if self.known is None:
            self.known = [] if self.first is None else self.code.encode(self.body[self.first : self.last])
        return self.known

    def _head(self, entry: State) -> list[int] | None:
        """Ids from an entry to the first free place, None if none lead there."""
        over, piece = entry
        if over > self.first:
            return None
        pieces, begins = self.code.walk(self.body[: self.first], over, piece)
        return self.code.trace(pieces, begins, over, self.first) if pieces[self.first] is not None else None

    def _tails(self) -> list[list[int] | None]:
        """Ids from the last free place to each exit."""
        tail, stop = self.text[self.last :], self.stop - self.last
        pieces, begins = self.code.walk(tail, 0, "")
        ends = _ends(tail, self.soft_right, stop, self.exits, pieces)
        return [self.code.trace(pieces, begins, 0, stop + over) if ok else None for ok, (over, _) in zip(ends, self.exits, strict=True)]

    def transfer(self) -> np.ndarray:
        """Max-plus matrix, entries by exits: ids on the way, or minus infinity."""
        out = np.full((len(self.entries), len(self.exits)), NEVER)
        if self.first is None:
            for a, (over, piece) in enumerate(self.entries):
                if over <= self.stop:
                    pieces, begins = self.code.walk(self.text, over, piece)
                    for b, ok in enumerate(_ends(self.text, self.soft_right, self.stop, self.exits, pieces)):
                        if ok:
                            out[a, b] = len(self.code.trace(pieces, begins, over, self.stop + self.exits[b][0]))
            return out
        after = np.array([NEVER if ids is None else len(ids) for ids in self._tails()])
        for a, entry in enumerate(self.entries):
            head = self._head(entry)
            if head is not None:
                out[a] = len(head) + len(self.inner()) + after
        return out

    def backtrace(self, entry: int, leave: int) -> list[int]:
        """Ids between an entry and an exit that the transfer matrix joins."""
        if self.first is None:
            (over, piece), (beyond, _) = self.entries[entry], self.exits[leave]
            pieces, begins = self.code.walk(self.text, over, piece)
            return self.code.trace(pieces, begins, over, self.stop + beyond)
        return [*self._head(self.entries[entry]), *self.inner(), *self._tails()[leave]]


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative, so chunks may be combined in any grouping."""
    out = np.full((a.shape[0], b.shape[1]), NEVER)
    for k in range(a.shape[1]):
        out = np.maximum(out, a[:, k : k + 1] + b[k : k + 1, :])
    return out


def choose(transfers: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[tuple[int, int]]:
    """The entry and exit of each of some neighbours on the best path from an entry of the first to an exit of the last.

    Suffix products say what can still be reached.
    """
    end = np.full((transfers[-1].shape[1], 1), NEVER)
    end[leave] = 0
    suffix = [end]
    for t in reversed(transfers[1:]):
        suffix.append(compose(t, suffix[-1]))
    at, path = enter, []
    for t, then in zip(transfers, reversed(suffix), strict=True):
        out = int(np.argmax(t[at] + then[:, 0]))
        path.append((at, out))
        at = out
    return path


def _list_array(rows: list[list[int]]) -> pa.Array:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """Piece ids of every whole text, as the model's own library gives them.

    Texts of up to ``chunk`` code points are one chunk, whose matrix is 1 x 1: they are walked at once and never leave
    their task. Longer texts are cut into chunks that are rows of their own: each yields its max-plus transfer matrix between the states
    at its two ends, the matrices of a text are combined up a tree of FAN children a node, the states that the best path passes are
    handed down it, and each chunk is then backtraced by itself; what no state at its ends can change is encoded once, with the matrix.
    Equal long texts are encoded once.

    Null texts count as empty and have no ids; rows that repeat are encoded each; of other columns those in
    ``carry`` are kept.

    Returns the carried columns and ids (array<int>); with ``decoded`` also what decode() makes of the ids, in the same pass.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*carry, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    big = F.char_length("__text") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids = [code.encode(escape(t)) for t in texts]
            code.forget()
            columns = [*batch.columns[:-1], _list_array(ids)]
            if decoded:
                columns.append(pa.array(map(code.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*carry, "ids", "decoded"][: len(columns)])

    small = rows.where(~big).mapInArrow(giving_back(whole), f"{kinds}, ids array<int>" + ", decoded string" * decoded)
    giants = materialise(rows.where(big).withColumn("__key", F.sha2("__text", 256)))
    if giants.isEmpty():
        return small
    long = _encode_giants(giants.select("__key", "__text").dropDuplicates(["__key"]), path, chunk)
    large = giants.drop("__text").join(long, "__key").drop("__key")
    return small.unionByName(decode(large, path) if decoded else large)


def _encode_giants(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = codec(path).longest
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = escape(text)
                places = cut_places(text, chunk)
                made = [
                    (key, k, len(places) - 1, text[max(0, a - longest) : a], text[a:b], text[b : b + longest], _soft(text, a), _soft(text, b))
                    for k, (a, b) in enumerate(zip(places, places[1:], strict=False))
                ]
                for at in range(0, len(made), 64):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, m, strict=True)) for m in made[at : at + 64]])

    names = ["key", "k", "n", "left", "body", "right", "soft_left", "soft_right"]
    chunks = materialise(
        giants.mapInArrow(giving_back(cut), "key string, k long, n long, left string, body string, right string, soft_left boolean, soft_right boolean")
        .repartition("key", "k")
    )

    def made(row: dict) -> Chunk:
        return Chunk(codec(path), *(row[c] for c in names[3:]), row.get("inner"))

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [made(r) for r in batch.to_pylist()]
            weights = [p.transfer() for p in parts]
            columns = [pa.array([w.shape[1] for w in weights], pa.int64()), pa.array([w.ravel().tolist() for w in weights], pa.list_(pa.float64())), _list_array([p.inner() for p in parts])]
            codec(path).forget()
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), *columns], ["key", "k", "width", "weights", "inner"])

    def matrices(group: pd.DataFrame) -> list[np.ndarray]:
        return [np.asarray(w).reshape(-1, int(n)) for w, n in zip(group["weights"], group["width"], strict=True)]

    def product(group: pd.DataFrame) -> pd.DataFrame:
        made = reduce(compose, matrices(group.sort_values("k")))
        return pd.DataFrame({"key": group["key"].iloc[:1], "k": group["parent"].iloc[:1], "width": [made.shape[1]], "weights": [made.ravel().tolist()]})

    def paths(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        found = choose(matrices(group), int(group["came"].iloc[0]), int(group["goes"].iloc[0]))
        return pd.DataFrame({"key": group["key"], "k": group["k"], "enter": [a for a, _ in found], "leave": [b for _, b in found]})

    kind = "key string, k long, width long, weights array<double>"
    under = F.expr(f"k div {FAN}").alias("parent")
    walked = materialise(chunks.mapInArrow(giving_back(transfers), f"{kind}, inner array<int>"))
    levels = [walked.drop("inner")]
    most = chunks.agg(F.max("n")).first()[0] or 1
    while most > FAN:
        levels.append(materialise(levels[-1].select("*", under).groupBy("key", "parent").applyInPandas(product, kind)))
        most = -(-most // FAN)
    # a text begins and ends in one state, so its whole path enters and leaves by the first
    chosen = levels[-1].select("key", F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("came"), F.lit(0).cast("long").alias("goes")).distinct()
    for level in reversed(levels):
        chosen = level.select("*", under).join(chosen, ["key", "parent"]).groupBy("key", "parent").applyInPandas(paths, "key string, k long, enter long, leave long")
        if level is not levels[0]:
            chosen = chosen.select("key", F.col("k").alias("parent"), F.col("enter").alias("came"), F.col("leave").alias("goes"))

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            ids = _list_array([made(r).backtrace(r["enter"], r["leave"]) for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), ids], ["key", "k", "ids"])

    traced = chunks.join(walked.select("key", "k", "inner"), ["key", "k"]).join(chosen, ["key", "k"]).mapInArrow(giving_back(traces), "key string, k long, ids array<int>")
    return traced.groupBy(F.col("key").alias("__key")).agg(
        F.expr("flatten(transform(array_sort(collect_list(struct(k, ids))), x -> x.ids))").alias("ids")
    )


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text that the ids stand for; null ids give null."""
    small_batches(encoded.sparkSession)
    others = [c for c in encoded.columns if c != "decoded"]
    at = others.index(ids_col)
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in batches:
            texts = [None if ids is None else code.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*others, "decoded"])

    return encoded.select(*others).mapInArrow(giving_back(run), f"{kinds}, decoded string")
