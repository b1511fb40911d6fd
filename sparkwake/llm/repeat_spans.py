"""Repeated strings of bytes or words by a difference-cover suffix sort, bounded to the length that matters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, giving_back, materialise, small_batches

#: Bytes of a string that counts as repeated, and words of a passage that does.
LENGTH, PASSAGE = 400, 50
#: The difference cover is one modulo Q * Q + Q + 1, of Q + 1 residues; Q is prime. For bytes, and for words.
Q, WORD_Q = 13, 5
#: Names that one bucket of a sort should hold.
BUCKET_NAMES = 800_000
#: Names that a task compares with each other before it sends them; names it remembers as sent and repeated.
FLUSH_NAMES, KNOWN_NAMES = 400_000, 1_000_000
#: Symbols that are hashed at a time.
PART = 1 << 20
#: Parts in which a text's copies look up that they are copies.
SALTS = 32

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


@lru_cache(maxsize=4)
def difference_cover(q: int = Q) -> tuple[int, tuple[int, ...]]:
    """Modulus and residues such that any two positions, moved on by the same amount below the modulus, both fall on residues.

    The powers of a primitive element of GF(q^3) that lie in a plane, taken modulo q^2 + q + 1 (Singer's construction): each
    difference occurs exactly once.
    """
    v = q * q + q + 1
    for code in range(q**3):
        a, b, c = code // (q * q), code // q % q, code % q
        x, plane, order = (0, 0, 1), [], 0
        while True:
            if x[0] == 0:
                plane.append(order % v)
            x = ((x[1] + x[0] * a) % q, (x[2] + x[0] * b) % q, x[0] * c % q)
            order += 1
            if x == (0, 0, 1) or order >= q**3:
                break
        if c and order == q**3 - 1:
            return v, tuple(sorted(set(plane)))
    raise ValueError(f"{q} is no prime")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(1, 257, dtype=np.uint64)
    return _mix(codes * _A), _mix(codes * _B)


_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.ones(max(n, 1 << 16), np.uint64)
        held[1:] = base
        _powers[int(base)] = held = np.cumprod(held)
    return held[:n]


def _rolled(letters: tuple[np.ndarray, np.ndarray], starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two rolling hashes, one a family of letters, of what lies between starts and stops; independent of where it lies."""
    out = []
    for each, base in zip(letters, (_A, _B), strict=True):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        sums = np.zeros(len(each) + 1, np.uint64)
        np.cumsum(each * _power(base, len(each)), out=sums[1:])
        out.append((sums[stops] - sums[starts]) * _power(inverse, len(each) + 1)[starts])
    return out[0], out[1]


def _families(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if codes.dtype == np.uint8:
        return _letters()[0][codes], _letters()[1][codes]
    return _mix(codes * _A), _mix(codes * _B)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code of each word, a run without ASCII white space, of texts that lie end to end; and each text's first word."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    codes = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PART)))
        low = starts[at]
        a, b = _rolled(_families(data[low : stops[to - 1]]), starts[at:to] - low, stops[at:to] - low)
        codes[at:to] = _mix(_mix(a) + b)
        at = to
    return codes, np.searchsorted(starts, offsets)


def window_names(codes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the windows that begin at the sorted ``starts``, and 32 further bits that deal them to buckets."""
    names, tags = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for at in range(0, len(codes), PART):
        here = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + PART)] - at
        if len(here):
            a, b = _rolled(_families(codes[at : at + PART + length]), here, here + length)
            names.append(_mix(_mix(a) + b))
            tags.append(_mix(a ^ _mix(b + _B)) >> np.uint64(32))
    return np.concatenate(names), np.concatenate(tags)


@dataclass(frozen=True)
class Measure:
    """Which strings count as repeated: so many units long, standing anywhere else, or (across) in another text."""

    unit: str
    length: int
    q: int
    across: bool

    @property
    def seed(self) -> int:
        """Units of a sampled name: what a string has left after the first sampled place that it shares with its equal."""
        return self.length - difference_cover(self.q)[0] + 1


@dataclass(frozen=True)
class Layout:
    """Buckets of each measure, numbered one after the other."""

    counts: tuple[int, ...]

    def first(self, measure: int) -> int:
        return sum(self.counts[:measure])

    def measure_of(self, bucket: int) -> int:
        return next(m for m in range(len(self.counts)) if bucket < self.first(m + 1))


BLOB = "bucket int, names binary, places binary, keys binary, sizes binary, counts binary"
SLICE = "slice int, places binary, keys binary, sizes binary, counts binary"
_KINDS = {"bucket": pa.int32(), "slice": pa.int32()}


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, _KINDS.get(n, pa.binary())) for c, n in zip(columns, names, strict=True)], names)


def _packed(key: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[bytes, ...]:
    """places, keys, sizes, counts of entries that lie text by text: place deltas, and which text has how many."""
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (size[1:] != size[:-1])))
    deltas = np.diff(place, prepend=0)
    deltas[first] = place[first]
    counts = np.diff(np.append(first, len(key)))
    return deltas.astype(np.uint32).tobytes(), key[first].tobytes(), size[first].tobytes(), counts.astype(np.uint32).tobytes()


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, size and place of each entry of packed rows."""
    column = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    counts = column("counts", np.uint32).astype(np.int64)
    ends = np.cumsum(counts)
    running = np.cumsum(column("places", np.uint32).astype(np.int64))
    before = np.repeat(np.append(0, running[ends[:-1] - 1]) if len(ends) else ends, counts)
    return np.repeat(column("keys", np.int64), counts), np.repeat(column("sizes", np.int64), counts), running - before


class _Packer:
    """Names of many texts, dealt to buckets, and compared within the task before they are sent.

    What repeats here is known to be repeated, so only one entry of such a name goes to its bucket, once a task, and the others
    travel as places alone. So a string that stands in a third of all texts costs its bucket an entry a task.
    """

    def __init__(self, first: int, buckets: int, across: bool):
        self.first, self.buckets, self.across = first, buckets, across
        self.known = np.zeros(0, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.names, self.tags, self.places, self.owner, self.keys, self.held = [], [], [], [], {}, 0

    def fresh(self, keys: list[tuple[int, int]]) -> np.ndarray:
        """Which texts have no equal before them among those not sent yet; they are noted."""
        out = np.zeros(len(keys), bool)
        for i, key in enumerate(keys):
            if key not in self.keys:
                self.keys[key] = len(self.keys)
                out[i] = True
        return out

    def add(self, owner: np.ndarray, places: np.ndarray, names: np.ndarray, tags: np.ndarray) -> None:
        for to, what in ((self.names, names), (self.tags, tags), (self.places, places), (self.owner, owner)):
            to.append(what)
        self.held += len(names)

    def rows(self) -> Iterator[tuple]:
        """BLOB rows of what was added since the last call; those without names are places known to be repeated."""
        if self.held:
            names, tags, places, owner = (np.concatenate(x) for x in (self.names, self.tags, self.places, self.owner))
            keys = np.array(list(self.keys), np.int64)
            order = np.argsort(names, kind="stable")
            sorted_names, sorted_tags = names[order], tags[order]
            new = np.append(True, (sorted_names[1:] != sorted_names[:-1]) | (sorted_tags[1:] != sorted_tags[:-1]))
            start, group = np.flatnonzero(new), np.cumsum(new) - 1
            if self.across:
                repeated = np.minimum.reduceat(owner[order], start) != np.maximum.reduceat(owner[order], start)
            else:
                repeated = np.diff(np.append(start, len(order))) > 1
            sent = _among(sorted_names[start], self.known)
            hit = (repeated | sent)[group]
            send = ~hit
            send[start[repeated & ~sent]] = True
            self.known = np.union1d(self.known, sorted_names[start[repeated]])
            if len(self.known) > KNOWN_NAMES:
                self.known = np.zeros(0, np.uint64)
            sends, hits = np.sort(order[send]), np.sort(order[hit])
            bucket = (tags[sends] % np.uint64(self.buckets)).astype(np.int64)
            for these in _split(bucket):
                at = sends[these]
                yield self.first + int(bucket[these[0]]), names[at].tobytes(), *_packed(*keys[owner[at]].T, places[at])
            if len(hits):
                yield self.first + int(keys[owner[hits[0]], 0] % self.buckets), None, *_packed(*keys[owner[hits]].T, places[hits])
        self._clear()


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _split(group: np.ndarray) -> list[np.ndarray]:
    """Places of each value, in order."""
    order = np.argsort(group, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _named(measures: list[Measure], layout: Layout, places_of: Callable, length_of: Callable, flush: int) -> Callable:
    """For mapInArrow: names the windows of length_of(measure) at the places that places_of says, and packs them.

    The texts of a batch are hashed end to end. places_of(measure, its number, batch, first symbol of each text, which texts are asked) -> text and
    place of each window, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = [_Packer(layout.first(m), layout.counts[m], measure.across) for m, measure in enumerate(measures)]
        for batch in batches:
            column = batch.column("bytes")
            offsets = np.append(0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)))
            data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
            keys = list(zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), strict=True))
            for m, (measure, packer) in enumerate(zip(measures, packers, strict=True)):
                codes, first = words_of(data, offsets) if measure.unit == "word" else (data, offsets)
                asked = packer.fresh(keys) & (np.diff(first) >= measure.length)
                text, place = places_of(measure, m, batch, first, asked)
                number = np.array([packer.keys[k] for k in keys], np.int64)
                packer.add(number[text], place, *window_names(codes, first[text] + place, length_of(measure)))
                if packer.held >= flush:
                    yield from _table(list(packer.rows()), BLOB_NAMES).to_batches()
        for packer in packers:
            yield from _table(list(packer.rows()), BLOB_NAMES).to_batches()

    return giving_back(run)


def _sampled(measure: Measure, m: int, batch: pa.RecordBatch, first: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places on the difference cover."""
    v, residues = difference_cover(measure.q)
    rooms = np.where(asked, np.diff(first) - measure.seed + 1, 0)
    marks = np.zeros(v, bool)
    marks[list(residues)] = True
    every = np.flatnonzero(np.resize(marks, rooms.max(initial=0)))
    counts = np.searchsorted(every, rooms)
    return np.repeat(np.arange(len(rooms)), counts), every[_ranges(counts)]


def _reached(measure: Measure, m: int, batch: pa.RecordBatch, first: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places from which a repeated sampled one is within reach."""
    v = difference_cover(measure.q)[0]
    hits = [_read_places(p) if p is not None and ok else np.zeros(0, np.int64) for p, ok in zip(batch.column(f"places_{m}").to_pylist(), asked, strict=True)]
    counts = np.fromiter(map(len, hits), np.int64, len(hits))
    hits, start = np.concatenate([*hits, np.zeros(0, np.int64)]), np.repeat(first[:-1], counts)
    reach = np.zeros(first[-1] + 1, np.int32)
    np.add.at(reach, start + np.maximum(hits - v + 1, 0), 1)
    np.add.at(reach, start + hits + 1, -1)
    found = np.flatnonzero(np.cumsum(reach, dtype=np.int32)[:-1])
    text = np.searchsorted(first, found, side="right") - 1
    fits = found + measure.length <= first[text + 1]
    return text[fits], (found - first[text])[fits]


BLOB_NAMES = [c.split()[0] for c in BLOB.split(", ")]
SLICE_NAMES = [c.split()[0] for c in SLICE.split(", ")]


def _repeated(table: pa.Table, measures: list[Measure], layout: Layout) -> pa.Table:
    """Sort a bucket's names and compare neighbours: the places of those names that stand at two places or more.

    Copies of one text have one key, so their equal places are one. The places go, text after text, to the slice of
    the texts that a later group gathers.
    """
    m = layout.measure_of(table.column("bucket")[0].as_py())
    sure, table = table.filter(pc.is_null(table.column("names"))), table.filter(pc.is_valid(table.column("names")))
    names = np.frombuffer(b"".join(table.column("names").to_pylist()), np.uint64)
    key, size, place = _entries(table)
    order = np.lexsort((place, size, key, names))
    names, key, size, place = names[order], key[order], size[order], place[order]
    same = names[1:] == names[:-1]
    other = same & ((key[1:] != key[:-1]) | (size[1:] != size[:-1]) | ((place[1:] != place[:-1]) & (not measures[m].across)))
    group = np.cumsum(np.append(True, ~same)) - 1 if len(names) else np.zeros(0, np.int64)
    varied = np.zeros(group[-1] + 1 if len(group) else 0, bool)
    varied[group[1:][other]] = True
    hit = varied[group]
    key, size, place = (np.concatenate([x[hit], y]) for x, y in zip((key, size, place), _entries(sure), strict=True))
    order = np.lexsort((place, size, key))
    key, size, place = key[order], size[order], place[order]
    part = key % layout.counts[m]
    rows = [(layout.first(m) + int(part[these[0]]), *_packed(key[these], size[these], place[these])) for these in _split(part)]
    return _table(rows, SLICE_NAMES)


def _gathered(table: pa.Table, layout: Layout) -> tuple[int, list[tuple[int, int, np.ndarray]]]:
    """The measure of a slice, and all places of each of its texts, sorted."""
    key, size, place = _entries(table)
    order = np.lexsort((place, size, key))
    key, size, place = key[order], size[order], place[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (size[1:] != size[:-1]))) if len(key) else []
    return layout.measure_of(table.column("slice")[0].as_py()), [
        (int(key[a]), int(size[a]), np.unique(place[a:b])) for a, b in zip(first, [*first[1:], len(key)], strict=True)
    ]


def _placed(table: pa.Table, layout: Layout) -> pa.Table:
    m, found = _gathered(table, layout)
    places = [np.diff(p, prepend=0).astype(np.uint32).tobytes() for _, _, p in found]
    columns = [pa.array([m] * len(found), pa.int32()), pa.array([k for k, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array(places, pa.binary())]
    return pa.table(columns, ["measure", "key", "n", "places"])


def _covered(table: pa.Table, measures: list[Measure], layout: Layout) -> pa.Table:
    """Spans of each text of a slice: gathering and covering in one worker, as a second would only hold more memory."""
    m, found = _gathered(table, layout)
    spans = [[{"start": a, "stop": b} for a, b in cover(p, measures[m].length)] for _, _, p in found]
    columns = [pa.array([m] * len(found), pa.int32()), pa.array([k for k, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64())]
    return pa.table([*columns, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["measure", "key", "n", "spans"])


def _read_places(deltas: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(deltas, np.uint32).astype(np.int64))


def cover(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that windows at the sorted ``starts`` cover."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, new + 1)].tolist(), (starts[np.append(new, len(starts) - 1)] + length).tolist(), strict=True))


def _lane(row_id: str) -> Column:
    """0, or for rows without an id any of the parts in which they look up their text."""
    return F.when(F.col(row_id).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))


def _lanes(row_id: str) -> Column:
    """All lanes in which rows of that id may ask."""
    each = F.array(*[F.lit(k).cast("long") for k in range(SALTS)])
    return F.explode(F.when(F.col(row_id).isNull(), each).otherwise(F.slice(each, 1, 1)))


def _by_row(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on doc_id, null or not, and keys."""
    right = right.withColumnsRenamed({c: f"__{c}" for c in ("doc_id", *keys)})
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id"))
    for c in keys:
        same &= F.col(c) == F.col(f"__{c}")
    return left.join(right, same, how).drop("__doc_id", *[f"__{c}" for c in keys])


SPANS = "array<struct<start:bigint,stop:bigint>>"


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, passage: int | None = None, word_q: int = WORD_Q
) -> DataFrame:
    """Spans of each text's bytes that lie in a string of ``length`` bytes which also starts anywhere else.

    With ``passage`` also spans of its words (runs without ASCII white space) that lie in a run of so many words which also stands in
    another text, or in all of the text if it has that many words and occurs more than once.

    1. Sample: suffixes at positions of a difference cover get names, the fingerprints of their first
       length - v + 1 bytes; buckets of names are sorted and neighbours compared. For any two equal strings of ``length`` bytes some
       offset below v has both in the sample, so a string whose sampled suffixes are all unique is unique.
    2. Merge: the remaining suffixes are ordered only where a sampled one within reach is repeated: these get names of all their
       ``length`` bytes, are sorted likewise, and a suffix whose neighbour has the same prefix is repeated.
    3. Texts that occur as a whole more than once need neither: if long enough, all of them is repeated.

    Names are fingerprints where the classical algorithm has dense ranks, and the recursion is two levels deep, as only ``length``
    bytes matter; neither level needs a global order. Strings are told apart by 64 bits and, independent of these, the bucket, so among n
    names about n * BUCKET_NAMES / 2^65 pairs of different strings are expected to be confused: 2e-6 at 10^8 names, 0.4 at 2 * 10^13. A
    name that repeats within a task reaches its bucket once a task, so a hot passage costs a bucket an entry a task, not an entry a
    text. Text keys are a 64-bit hash and the length.

    Null texts are empty; texts under ``length`` bytes have no spans; very long texts are hashed in parts; rows
    that repeat are copies of each other, as any equal texts; rows without an id count as any others. Other columns are ignored.

    Returns doc_id, key, n_bytes, spans (array<struct<start,stop>>, bytes) and, if asked for, passages (likewise, words) — one row per
    input row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    measures = [Measure("byte", length, q, False)] + ([Measure("word", passage, word_q, True)] if passage else [])
    if any(m.seed < 1 for m in measures):
        raise ValueError("the string length must reach the cover's modulus")
    least = min(length, 2 * passage - 1) if passage else length
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_count(text, F.lit(WORD)) if passage else F.lit(0)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("n"), text.cast("binary").alias("bytes"))
    narrow = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("n"), words.cast("long").alias("words"))
    )
    long_enough = narrow.where(F.col("n") >= least)
    totals = long_enough.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    texts = long_enough.groupBy("key", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("speaker"))

    def sort(rows: DataFrame, layout: Layout, places_of: Callable, length_of: Callable, gather: Callable, schema: str) -> DataFrame:
        """What ``gather`` makes of the places of repeated names, one row per text and measure that has any."""
        blobs = rows.mapInArrow(_named(measures, layout, places_of, length_of, FLUSH_NAMES), BLOB)
        found = blobs.groupBy("bucket").applyInArrow(lambda t: _repeated(t, measures, layout), SLICE)
        return found.groupBy("slice").applyInArrow(gather, schema)

    def per_text(df: DataFrame, what: str, names: list[str]) -> DataFrame:
        """A row per text, with a column for each measure."""
        return df.groupBy("key", "n").agg(*[F.first(F.when(F.col("measure") == m, F.col(what)), ignorenulls=True).alias(x) for m, x in enumerate(names)])

    share = [len(c) / v for v, c in (difference_cover(m.q) for m in measures)]
    layout = Layout(tuple(max(1, -(-int(n * part) // BUCKET_NAMES)) for n, part in zip(totals, share, strict=False)))
    hits = materialise(
        sort(keyed.where(F.col("n") >= least).select("key", "n", "bytes"), layout, _sampled, lambda m: m.seed, lambda t: _placed(t, layout), "measure int, key long, n long, places binary")
    )
    found = {r["measure"]: r["n"] for r in hits.groupBy("measure").agg(F.sum(F.expr("octet_length(places) div 4")).alias("n")).collect()}
    second = Layout(tuple(max(1, -(-int(found.get(m, 0) / part * 2) // BUCKET_NAMES)) for m, part in enumerate(share)))
    places = [f"places_{m}" for m in range(len(measures))]
    asked = per_text(hits, "places", places).join(texts, ["key", "n"]).select("key", "n", *places, F.col("speaker").alias("doc_id")).withColumn("lane", _lanes("doc_id"))
    near = materialise(_by_row(keyed.withColumn("lane", _lane("doc_id")), asked, ["key", "n", "lane"], "inner").select("doc_id", "key", "n", "bytes", *places))
    # of the rows of a text that has no id at all, one speaks
    near = near.where("doc_id is not null").unionByName(near.where("doc_id is null").dropDuplicates(["key", "n"])).drop("doc_id")
    spans = materialise(sort(near, second, _reached, lambda m: m.length, lambda t: _covered(t, measures, second), f"measure int, key long, n long, spans {SPANS}"))
    # copies may be many: they find their text in salted parts; a text that stands alone is found by its row's id
    outs = ["spans", "passages"][: len(measures)]
    salt = F.when(F.col("doc_id").isNull(), _lane("doc_id")).otherwise(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(SALTS)))
    copied = texts.where("copies > 1").select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(True).alias("copied"))
    single = per_text(spans, "spans", outs).join(texts.where("copies = 1"), ["key", "n"]).select("key", "n", F.col("speaker").alias("doc_id"), *outs).withColumn("lane", F.lit(-1).cast("long"))
    found = narrow.withColumn("salt", salt).join(copied, ["key", "n", "salt"], "left")
    found = _by_row(found.withColumn("lane", F.when(F.col("copied"), F.col("salt")).otherwise(F.lit(-1).cast("long"))), single, ["key", "n", "lane"], "left")
    none = F.expr(f"cast(array() as {SPANS})")
    whole = lambda size, least: F.when(F.col(size) >= least, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col(size).alias("stop")))).otherwise(none)
    every = zip(outs, ("n", "words"), (length, passage), strict=False)
    return found.select(
        "doc_id", "key", F.col("n").alias("n_bytes"), *[F.when(F.col("copied"), whole(size, least)).otherwise(F.coalesce(out, none)).alias(out) for out, size, least in every]
    )


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each text: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) and passages (none where spans has no such column).

    spans: as repeated_spans gives them for the same rows. Rows that repeat an id, or have none, are told apart by their texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("bytes"))
    if "passages" not in spans.columns:
        spans = spans.withColumn("passages", F.expr(f"cast(array() as {SPANS})"))
    some = materialise(spans.where((F.size("spans") > 0) | (F.size("passages") > 0)))
    some = some.dropDuplicates(["doc_id", "key", "n_bytes"]).withColumn("lane", _lanes("doc_id"))
    cut = _by_row(keyed.withColumn("lane", _lane("doc_id")), some, ["key", "n_bytes", "lane"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digests, kept = [], [], [], []
            for data, found in zip(batch.column("bytes").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                found = found or []
                edges = [0, *(x for s in found for x in (s["start"], s["stop"])), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                removed.append(len(data) - len(rest))
                runs.append(len(found))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            made = [pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "passages"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made, batch.column("passages")], names)

    kind = docs.schema[id_col].dataType.simpleString()
    none = F.expr(f"cast(array() as {SPANS})")
    return cut.select("doc_id", "n_bytes", "bytes", "spans", F.coalesce("passages", none).alias("passages")).mapInArrow(
        giving_back(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, passages {SPANS}"
    )
