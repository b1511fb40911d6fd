"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded block selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, md5_int, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 18
#: Blocks that one task should draw from.
TASK_BLOCKS = 1 << 17
SEED = "mix-1"


def sainte_lague(parties: DataFrame, groups: list[str], party: str, weight: Column, seats: Column) -> DataFrame:
    """Give each group's seats to its parties by the highest quotients weight / (2k - 1).

    Each party's seats lie between two divisor roundings, so only about two quotients a party are ranked,
    however many seats there are. Ties go to the smaller party.
    """
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    sized = parties.withColumns({"w": weight.cast("double"), "n": seats.cast("double")}).where("w > 0 and n > 0")
    sized = sized.withColumns({"total": F.sum("w").over(over), "m": F.count("*").over(over)})
    bounds = sized.withColumns({
        "lo": F.greatest(F.lit(0), F.floor(F.expr("w * (n - m / 2.0) / total + 0.5")) - 1),
        "hi": F.floor(F.expr("w * (n + m / 2.0) / total + 0.5")) + 1,
    }).withColumn("open", F.col("n") - F.sum("lo").over(over))
    keys = [*groups, party]
    ranked = bounds.select(*keys, "w", "open", "lo", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("k")).withColumn(
        "nth", F.row_number().over(over.orderBy(F.expr("w / (2 * k - 1)").desc(), party, "k"))
    )
    return ranked.groupBy(*keys).agg((F.max("lo") + F.sum((F.col("nth") <= F.col("open")).cast("long"))).alias("seats"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """Water-fill the total size over sources by weight; a source stops at ``most`` times its size.

    sizes: skey, source, source_size — one row per source. Sources whose cap binds are a prefix in order of
    cap / weight, so one running sum finds the level; all sums are integers, hence exact.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * most)
    whole = Window.partitionBy(F.lit(0))
    tight = whole.orderBy(F.expr("cast(cap as double) / weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    left = weighed.withColumns({
        "rest": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "rest_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "nth": F.row_number().over(tight),
    }).withColumn("free", F.expr("cap * rest_weight > rest * weight"))
    first = F.min(F.when(F.col("free"), F.struct("nth", "rest", "rest_weight"))).over(whole)
    return left.withColumn("first", first).select(
        "skey",
        "source",
        "source_size",
        F.expr(
            "case when first is null or nth < first.nth then cast(cap as double)"
            " else cast(first.rest * weight as double) / cast(first.rest_weight as double) end"
        ).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    A source's documents are dealt by a seeded hash to shards of about ``shard_words`` words, so a source
    that holds most of the corpus has many shards. Within a shard the documents lie end to end in seeded order and
    are cut into blocks of ``block`` words. Sainte-Laguë gives each source, and within it each shard, a
    whole number of blocks; a shard takes all its blocks as often as the quota allows, then a seeded
    choice of them once more.

    Targets and quotas of sources are ranked in one task, a row a source; sources are few beside documents, however many those are.

    Null texts have size 0 and are never taken; a null source is a source of its own, the last by name. Rows that
    repeat are documents of their own. Other columns are ignored; an empty table gives no rows.

    Returns doc_id, size, source_size, target, taken — one row per input row.
    """
    return _mixed(docs, id_col, text_col, source_col, block, shard_words, seed).drop("skey")


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, shard_words: int, seed: str) -> DataFrame:
    sized = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
        .withColumn("skey", _source_key("source"))
    )
    sources = source_targets(
        sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    )
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    sources = materialise(
        sources.withColumns({
            "blocks": F.greatest(F.lit(1), F.floor((total + block // 2) / block)),
            "shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)),
        })
    )
    seats = sainte_lague(sources, [], "skey", F.col("target"), F.col("blocks"))
    placed = sized.where("size > 0").join(sources.select("skey", "shards"), "skey").select(
        "skey",
        "doc_id",
        "size",
        (md5_int(F.lit(seed), "doc_id") % F.col("shards")).alias("shard"),
        F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), "doc_id")).alias("turn"),
    )
    line = Window.partitionBy("skey", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("start", F.sum("size").over(line) - F.col("size")).drop("turn")
    shards = laid.groupBy("skey", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = sainte_lague(shards.join(seats, "skey"), ["skey"], "shard", F.col("shard_size"), F.col("seats"))
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    chosen = (
        shards.join(quotas, ["skey", "shard"])
        .withColumn("n", F.ceil(F.col("shard_size") / block))
        .withColumn("quota", F.least("seats", F.col("n") * MAX_REPEAT))
        .where("quota > 0")
        # a given number, as the shards are few rows, but not the blocks that they are exploded to
        .repartition(max(1, -(-int(words) // (block * TASK_BLOCKS))), "skey", "shard")
        .select("skey", "shard", "n", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"))
    )
    draw = Window.partitionBy("skey", "shard").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "skey", "shard", "b")), "b")
    chosen = chosen.select(
        "skey", "shard", "b", F.expr("quota div n").alias("times"), (F.row_number().over(draw) <= F.expr("quota % n")).cast("long").alias("once_more")
    ).select("skey", "shard", "b", (F.col("times") + F.col("once_more")).alias("copies")).where("copies > 0")
    pieces = laid.select(
        "*", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("b")
    ).withColumn("words", F.expr(f"least(start + size, (b + 1) * {block}) - greatest(start, b * {block})"))
    taken = (
        # hinted, as the planner takes the blocks for as few as the shards they are exploded from, and would broadcast them
        pieces.join(chosen.hint("merge"), ["skey", "shard", "b"], "left")
        .groupBy("skey", "shard", "start", "doc_id", "size")
        .agg(F.sum(F.col("words") * F.coalesce("copies", F.lit(0))).alias("taken"))
        .select("skey", "doc_id", "size", "taken")
    )
    none = sized.where("size = 0").select("skey", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).join(sources.select("skey", "source_size", "target"), "skey").select(
        "skey", "doc_id", "size", "source_size", "target", "taken"
    )


def draw_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: taken / size times, the fraction by a seeded draw.

    Rows that repeat an id, or have none, are told apart by size and source, and where these agree share what is taken of
    them. Rows without an id draw by their texts, so that they do not all draw alike; of these, equal texts still do.
    """
    mixed = _mixed(docs, id_col, text_col, source_col, BLOCK_WORDS, SHARD_WORDS, seed)
    shares = mixed.where("size > 0").groupBy("doc_id", "size", "skey").agg((F.sum("taken") / F.count("*") / F.col("size")).alias("__ratio"))
    shares = shares.where("__ratio > 0").select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("skey").alias("__skey"), "__ratio")
    drawn_by = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("no id|"), F.md5(text_col)))
    keyed = docs.withColumns({
        "__words": word_count(F.col(text_col)),
        "__source": _source_key(source_col),
        "__chance": md5_int(F.lit(seed), F.lit("copies"), drawn_by) / F.lit(float(1 << 32)),
    })
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__size")) & (F.col("__source") == F.col("__skey"))
    copies = F.floor("__ratio") + (F.col("__chance") < F.col("__ratio") - F.floor("__ratio")).cast("long")
    return keyed.join(shares, same).withColumn("__copies", copies).where("__copies > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    ).select(*docs.columns)
