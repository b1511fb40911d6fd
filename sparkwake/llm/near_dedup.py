"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimates, exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, giving_back, materialise, pieces, small_batches, worker_cache

#: Registers of a sketch; a band is BAND of them in a row.
REGISTERS, BAND = 192, 6
#: The least threshold for which the bands miss no more than 6e-5 of the pairs, and sets without a sketch (under 4 shingles) cannot link.
LEAST_PERCENT = 80
MANTISSA = 10
EMPTY = 0xFFFF
#: By number of shingles: from this size on a sketch has so many independent hash functions, so registers fill.
SIZES = ((4, 32), (64, 8), (256, 4), (1024, 1))
#: A pair this far below the threshold by its estimate is not verified: 5.5 standard errors at 192 registers.
SLACK = 0.16
#: Members of a bucket that are compared with each other at a time, and shingles in their sets.
TILE, TILE_SHINGLES = 512, 2 << 20
#: Rounds in which members outside a bucket's main component meet one more member of it, before tiles.
STAR_ROUNDS = 1
#: Parts in which the copies of a set look up their component.
SALTS = 32
#: Distinct words, in each of two generations, whose hashes a worker remembers.
WORDS = 150_000
#: Links that one file of a round should hold.
FILE_LINKS = 1_000_000

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_SEEDS = (np.arange(1, 33, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).reshape(-1, 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; a shorter text is one shingle."""
    hashes = worker_cache(("word hashes",), lambda: Remembered(xxhash.xxh3_64_intdigest, WORDS))
    hashes.forget()
    each = [np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) for words in map(bytes.split, pieces(text.lower()))]
    h = np.concatenate(each) if each else np.zeros(0, np.uint64)
    if not len(h):
        return h
    width = min(width, len(h))
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ h[i : len(h) - width + 1 + i]) * _K[0]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(_mix(mixed))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        a, b = _mix(shingles + _K[0]).sum(dtype=np.uint64), _mix(shingles ^ _K[3]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def registers(shingles: np.ndarray, functions: int) -> np.ndarray:
    """Per bucket the smallest hash, stored as its count of leading zeros and the MANTISSA bits that follow."""
    buckets = REGISTERS // functions
    h = _mix(shingles[None, :] + _SEEDS[:functions])
    cell = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cell += np.arange(functions)[:, None] * buckets
    least = np.full(REGISTERS, 1 << 32, np.int64)
    np.minimum.at(least, cell.ravel(), (h & np.uint64(0xFFFFFFFF)).astype(np.int64).ravel())
    fraction, exponent = np.frexp(least.astype(np.float64))
    packed = ((32 - exponent) << MANTISSA) | ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    packed[least == 0] = 33 << MANTISSA
    packed[least == 1 << 32] = EMPTY
    return packed.astype(np.uint16)


def classes_of(n: int) -> list[int]:
    """Places in SIZES under which a set of n shingles has sketches: its own and, within reach of it, the one below."""
    own = max((i for i, (low, _) in enumerate(SIZES) if n >= low), default=-1)
    return [] if own < 0 else [own] + [own - 1] * (own > 0 and n * 4 <= SIZES[own][0] * 5)


def band_keys(regs: np.ndarray, place: int) -> np.ndarray:
    bands = regs.reshape(-1, BAND).astype(np.uint64)
    key = np.arange(len(bands), dtype=np.uint64) + np.uint64(1000 * (place + 1))
    for i in range(BAND):
        key = (key ^ bands[:, i]) * _K[0]
        key ^= key >> np.uint64(32)
    return _mix(key).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a, n_b) -> np.ndarray:
    """Jaccard similarity from registers in the last axis, less the matches that different minima give by chance."""
    filled = (a != EMPTY) | (b != EMPTY)
    match = ((a == b) & filled).sum(axis=-1) / np.maximum(filled.sum(axis=-1), 1)
    chance = 0.1699 * 2.0**-MANTISSA * 4 * n_a * n_b / (n_a + n_b) ** 2
    return (match - chance) / (1 - chance)


def _features(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            s = shingle_set(text or b"", width)
            places = classes_of(len(s))
            regs = [registers(s, SIZES[p][1]) for p in places]
            keys = [band_keys(r, p) for r, p in zip(regs, places, strict=True)]
            rows.append((len(s), *fingerprint(s), places[0] if places else None, *[r.tobytes() for r in regs], *[None] * (2 - len(regs)),
                         np.concatenate(keys) if keys else None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], ["doc_id", "text_key", "n", "f1", "f2", "place", "regs", "regs_below", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sets of representatives; of rows that share an id only those with the class's own set."""
    for batch in batches:
        ids, sets = [], []
        for text, rep, f1, f2 in zip(*(batch.column(c).to_pylist() for c in ("text", "rep", "f1", "f2")), strict=True):
            s = shingle_set((text or "").encode(), width)
            if fingerprint(s) == (f1, f2):
                ids.append(rep)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["rep", "set"])


def _comparable(place_a, regs_a, below_a, place_b, regs_b, below_b):
    """The two sketches made with the same hash functions; None if the sizes are too far apart to link."""
    if place_a == place_b:
        return regs_a, regs_b
    if place_a == place_b + 1:
        return (below_a, regs_b) if below_a is not None else None
    if place_b == place_a + 1:
        return (regs_a, below_b) if below_b is not None else None
    return None


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _promising(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for r in batch.to_pylist():
            pair = _comparable(*(r[f"{c}_{s}"] for s in "ab" for c in ("place", "regs", "regs_below")))
            keep.append(
                pair is not None
                and estimate(np.frombuffer(pair[0], np.uint16), np.frombuffer(pair[1], np.uint16), r["n_a"], r["n_b"]) >= percent / 100 - SLACK
            )
        yield batch.select(["a", "b", "comp_a", "comp_b"]).filter(pa.array(keep, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components, of those pairs that hold on the full sets."""
    for batch in batches:
        sets = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
        keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sets]
        yield batch.select(["comp_a", "comp_b"]).filter(pa.array(keep, pa.bool_())).rename_columns(["a", "b"])


def _tiles(batches: Iterator[pa.RecordBatch], handle: Callable[[list[dict]], list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, kind, i, j); each such tile is bounded and handled at once."""
    tile, at = [], None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            place = (row["key"], row["kind"], row["i"], row["j"])
            if place != at:
                out += handle(tile) if len(tile) > 1 else []
                tile, at = [], place
            tile.append(row)
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist(handle(tile) if len(tile) > 1 else [], schema)


def _tile_pairs(tile: list[dict], percent: int) -> list[tuple[float, int, int]]:
    """Pairs of a tile that belong to different components, may link, and have this band as their first common one."""
    band = tile[0]["band"]
    pick = lambda r: r["regs"] if r["place"] == band // 1000 else r["regs_below"]
    regs = np.stack([np.frombuffer(pick(r), np.uint16) for r in tile])
    n, comp, slot, rep, main = (np.array([r[c] for r in tile]) for c in ("n", "comp", "slot", "rep", "main"))
    kind, i, j = (tile[0][c] for c in ("kind", "i", "j"))
    found = []
    for x in range(len(tile) - 1):
        rest = np.arange(x + 1, len(tile))
        ok = (comp[rest] != comp[x]) & (rep[rest] != rep[x]) & (100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x]))
        if kind == 1:
            ok &= main[rest] != main[x]
        elif i != j:
            ok &= slot[rest] != slot[x]
        rest = rest[ok]
        if len(rest):
            est = estimate(regs[x], regs[rest], n[x], n[rest])
            same = (regs[rest] == regs[x]).reshape(len(rest), -1, BAND).all(axis=2)
            good = (est >= percent / 100 - SLACK) & (same.argmax(axis=1) == band % 1000)
            found += [(float(e), x, int(y)) for e, y in zip(est[good], rest[good], strict=True)]
    return found


def _touched(tile: list[dict], percent: int) -> list[dict]:
    touched = {k for _, x, y in _tile_pairs(tile, percent) for k in (x, y)}
    return [{c: tile[k][c] for c in ("key", "kind", "i", "j", "rep")} for k in sorted(touched)]


def _joined(tile: list[dict], percent: int) -> list[dict]:
    """Links between components, enough to connect all that verified pairs connect; likeliest pairs first."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    out = []
    for _, x, y in sorted(_tile_pairs(tile, percent), key=lambda p: (-p[0], p[1], p[2])):
        a, b = root(tile[x]["comp"]), root(tile[y]["comp"])
        if a != b and linked(np.frombuffer(tile[x]["set"], np.uint64), np.frombuffer(tile[y]["set"], np.uint64), percent):
            parent[max(a, b)] = min(a, b)
            out.append({"a": max(a, b), "b": min(a, b)})
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root (its smallest reachable node) of every node with an edge; edges: a, b (bigint).

    Large-star and small-star steps by turns until nothing changes; each round is a table in the shared folder.
    """
    step = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = None
    while (now := mark(step)) != seen:
        seen = now
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # by now a node is joined to smaller ones only, and of those to the least of each star that it was in
        large = large.distinct()
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
        again = low.select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        step = materialise(again.coalesce(max(1, -(-2 * now[0] // FILE_LINKS))))
    roots = step.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    1. Each text gets the size, a fingerprint and a HyperMinHash sketch of its set. Texts with equal sets
       form a class, and its smallest id speaks for it, so copies are never paired.
    2. Bands of registers are buckets. In each, every member is paired with one hub; pairs whose corrected
       estimate comes near the threshold are verified on the full sets, and what links is one component. In further rounds
       the members outside a bucket's main component meet other members of that.
    3. In buckets that still hold several components, members of different ones are all compared, in tiles of bounded size
       and each pair in its first common band only: again estimate first, then full sets. A tile returns only as many
       links as connect its components.

    A pair at the threshold itself shares no band with probability 6e-5, at 0.85 below 1e-6. Sets are compared as 64-bit hashes of
    their shingles: two different shingles of a pair of sets of n are taken for one with a chance of about n^2 / 2^64. ``percent`` must be
    LEAST_PERCENT or more.
    Texts without words (null, empty, blank) have an empty set and link with nothing; texts with fewer words than a shingle are one
    shingle. Very long texts are read in parts, and tiles are bounded by the shingles in their sets. Rows that repeat are members of their
    class; rows that share an id but not a set are judged each by its own. Ids must be bigint; rows without one come back with
    nulls. Other columns are ignored.

    Returns doc_id, n_shingles, component_id and text_key (xxhash64 of the text) — one row per input row.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"the bands are built for {LEAST_PERCENT} percent or more")
    spark = docs.sparkSession
    small_batches(spark)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))
    texts = every.where("doc_id is not null")
    features = materialise(
        texts.mapInArrow(
            giving_back(lambda b: _features(b, width)),
            "doc_id long, text_key long, n long, f1 long, f2 long, place int, regs binary, regs_below binary, keys array<bigint>",
        )
    )
    classes = materialise(
        features.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n", "place", "regs", "regs_below", "keys")).alias("m"), F.count("*").alias("copies"))
        .select("f1", "f2", F.col("m.doc_id").alias("speaker"), F.col("m.doc_id").alias("rep"), "m.n", "m.place", "m.regs", "m.regs_below", "m.keys", "copies")
    )
    shared = classes.groupBy("speaker").agg(F.count("*").alias("sets")).where("sets > 1")
    several = not shared.isEmpty()
    if several:
        # rows that share an id but not a set: each set is a node of its own
        own = F.when(F.col("sets").isNotNull(), -F.shiftrightunsigned(F.xxhash64("f1", "f2"), 1) - 1).otherwise(F.col("speaker"))
        classes = materialise(classes.join(shared, "speaker", "left").withColumn("rep", own).drop("sets"))
    bands = classes.select("rep", "n", F.posexplode("keys").alias("at", "key"), "place").select(
        "key", "rep", "n", F.expr(f"(if(at < {REGISTERS // BAND}, place, place - 1)) * 1000 + at % {REGISTERS // BAND}").cast("int").alias("band")
    )
    hubs = bands.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = materialise(bands.join(hubs.select("key", F.col("hub.rep").alias("hub"), "size"), "key"))
    needed = members.select("rep").distinct().join(classes.select("rep", "speaker", "f1", "f2"), "rep")
    sets = materialise(
        texts.join(needed, texts["doc_id"] == needed["speaker"]).select("text", "rep", "f1", "f2")
        .mapInArrow(giving_back(lambda b: _sets(b, width)), "rep long, set binary")
    )
    sketches = classes.select("rep", "n", "place", "regs", "regs_below")

    def verified(pairs: DataFrame) -> DataFrame:
        sketch = lambda side: sketches.select(F.col("rep").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "place", "regs", "regs_below")])
        side = lambda name: sets.select(F.col("rep").alias(name), F.col("set").alias(f"set_{name}"))
        promising = (
            pairs.join(sketch("a"), "a").join(sketch("b"), "b")
            .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
            .mapInArrow(giving_back(lambda b: _promising(b, percent)), "a long, b long, comp_a long, comp_b long")
        )
        return promising.join(side("a"), "a").join(side("b"), "b").mapInArrow(giving_back(lambda b: _verified(b, percent)), "a long, b long")

    def grown(comps: DataFrame, links: DataFrame) -> DataFrame:
        """Components once some of them are linked; only the linked ones are searched."""
        merged = components(links).withColumnRenamed("root", "to")
        return materialise(comps.join(merged, comps["comp"] == merged["node"], "left").select("rep", F.coalesce("to", "comp").alias("comp")))

    def split_buckets(comps: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
        """Members with their components, and of each bucket of several: the main one, its size and a member of it."""
        placed = members.join(comps, "rep").select("key", "rep", F.col("n").alias("shingles"), "band", "comp")
        several = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
        placed = materialise(placed.join(several, "key"))
        sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles"), F.min(F.struct(F.xxhash64(F.lit(seed), "rep").alias("h"), "rep")).alias("hub"))
        main = sizes.groupBy("key").agg(F.max(F.struct("n", -F.col("comp"), "comp", "hub.rep", "shingles")).alias("m"), F.sum("n").alias("total"), F.sum("shingles").alias("total_s"))
        return placed, main.select("key", F.col("m.comp").alias("main_comp"), F.col("m.n").alias("main_n"), F.col("m.shingles").alias("main_s"), F.col("m.rep").alias("hub"), "total", "total_s")

    comps = members.select("rep", F.col("rep").alias("comp")).distinct()
    stars = members.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    comps = grown(comps, verified(stars.withColumns({"comp_a": F.col("a"), "comp_b": F.col("b")})))
    for seed in range(1, STAR_ROUNDS + 1):
        placed, main = split_buckets(comps, seed)
        outside = placed.join(main, "key").where("comp <> main_comp").select(
            F.col("rep").alias("a"), F.col("hub").alias("b"), F.col("comp").alias("comp_a"), F.col("main_comp").alias("comp_b")
        )
        comps = grown(comps, verified(outside.distinct()))
    placed, main = split_buckets(comps, 0)
    slots = lambda count, shingles: F.greatest(F.lit(1), F.ceil(F.expr(f"({count}) / {TILE}")), F.ceil(F.expr(f"({shingles}) / {TILE_SHINGLES}"))).cast("int")
    dealt = placed.join(main, "key").select(
        "key", "rep", "band", "comp", (F.col("comp") == F.col("main_comp")).alias("main"), (F.expr(f"total <= {TILE} and total_s <= {TILE_SHINGLES}")).alias("small"),
        slots("main_n", "main_s").alias("mains"), slots("total - main_n", "total_s - main_s").alias("others"),
    ).withColumn("slot", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    place = "array<struct<kind:int,i:int,j:int>>"
    dealt = dealt.withColumn("tiles", F.expr(
        f"case when small then cast(array(struct(0, 0, 0)) as {place})"
        f" when main then cast(transform(sequence(0, others - 1), o -> struct(1, slot, o)) as {place})"
        f" else concat(cast(transform(sequence(0, mains - 1), m -> struct(1, m, slot)) as {place}),"
        f" cast(transform(sequence(0, others - 1), o -> struct(2, least(o, slot), greatest(o, slot))) as {place})) end"
    ))
    tiles = dealt.select("key", F.explode("tiles").alias("t"), "slot", "rep", "band", "comp", "main").select("key", "t.*", "slot", "rep", "band", "comp", "main")
    tile_key = ["key", "kind", "i", "j"]
    in_tiles = lambda df: df.repartition(*tile_key).sortWithinPartitions(*tile_key, "rep")
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("rep", pa.int64())])
    touched = materialise(
        in_tiles(tiles.join(sketches, "rep")).mapInArrow(
            giving_back(lambda b: _tiles(b, lambda t: _touched(t, percent), schema)), "key long, kind int, i int, j int, rep long"
        )
    )
    doubtful = touched.join(tiles, [*tile_key, "rep"]).join(sketches, "rep").join(sets, "rep")
    second = in_tiles(doubtful).mapInArrow(
        giving_back(lambda b: _tiles(b, lambda t: _joined(t, percent), pa.schema([("a", pa.int64()), ("b", pa.int64())]))), "a long, b long"
    )
    comps = grown(comps, second)
    # copies may be many: they find their class in salted parts; a set that stands alone is found by its row's id
    reps = classes.select("f1", "f2", "rep", "speaker", "copies").join(comps, "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    if several:
        least = reps.groupBy("component_id").agg(F.min("speaker").alias("least"))
        reps = reps.join(least, "component_id").withColumn("component_id", F.col("least"))
    copied = reps.where("copies > 1").select("f1", "f2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.col("component_id").alias("of_copies"))
    single = reps.where("copies = 1").select(F.col("speaker").alias("doc_id"), "f1", "f2", "component_id")
    sized = features.where("n > 0").select("doc_id", "text_key", "n", "f1", "f2", F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(SALTS)).alias("salt"))
    full = sized.join(copied, ["f1", "f2", "salt"], "left").join(single, ["doc_id", "f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("of_copies", "component_id").alias("component_id"), "text_key"
    )
    alone = features.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key")
    nameless = every.where("doc_id is null").select("doc_id", *[F.lit(None).cast("long").alias(c) for c in ("n_shingles", "component_id")], "text_key")
    return full.unionByName(alone).unionByName(nameless)
