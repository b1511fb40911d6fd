"""Strict feeds: JSON lines with exactly the declared keys, books as canonical JSON, append-only ledgers, price panels."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.asof import duplicates, label_rules, observation_rules
from ..schema import checked, empty_or_fail

_EVENT = "event_time long, available_time long, source_revision long, ingest_sequence long"
#: The roles of a feed and the exact columns of each.
ROLES = {
    "market": f"record_id string, instrument_id string, {_EVENT}, fields map<string,double>",
    "labels": f"label_id string, target_id string, received_time long, status string, value double, {_EVENT}",
    "universe": f"instrument_id string, start long, end long, {_EVENT}",
    "returns": "target_id string, decision_time long, realization_time long, available_time long, value double, source_revision long, status string",
    "costs": "target_id string, decision_time long, execution_time long, available_time long, cost_model_id string, fee_rate double, spread_rate double,"
    " slippage_rate double, impact_rate double, other_rate double, source_revision long, capacity_limit double",
    "delistings": f"instrument_id string, delisting_time long, delisting_return double, delisting_reason string, {_EVENT}",
}
IDENTITY = {"market": ["record_id"], "labels": ["label_id"], "universe": ["instrument_id", "start"], "returns": ["target_id"], "costs": ["target_id"], "delistings": ["instrument_id"]}


def schema_of(role: str) -> T.StructType:
    return T.StructType.fromDDL(ROLES[role])


def read_role(spark: SparkSession, path: str, role: str) -> DataFrame:
    """A role's JSON lines; a line that isn't an object with exactly the declared keys and types fails the read.

    Lines are read as text first, as a schema alone would drop unknown keys and fill missing ones with null.
    """
    wanted = schema_of(role)
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    keys = F.array_sort(F.json_object_keys("value"))
    parsed = F.from_json("value", T.StructType([*wanted.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    read = lines.select("value", keys.alias("keys"), parsed.alias("r"))
    exact = F.array(*[F.lit(c) for c in sorted(wanted.fieldNames())])
    good = checked(read, {f"{role}: keys differ from the declared ones": F.col("keys") == exact, f"{role}: value of another type": F.col("r._bad").isNull()})
    return good.select(*[F.col(f"r.{c}").alias(c) for c in wanted.fieldNames()])


def write_role(df: DataFrame, path: str, role: str) -> None:
    """JSON lines with all keys, nulls written out."""
    df.select(F.to_json(F.struct(*schema_of(role).fieldNames()), {"ignoreNullFields": "false"}).alias("value")).write.mode("error").text(path)


def read_feed(spark: SparkSession, folder: str, roles: tuple[str, ...] = tuple(ROLES)) -> dict[str, DataFrame]:
    """All roles of a feed, validated: the file set is exact, ids and revisions are unique, times are in order."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = {s.getPath().getName() for s in fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(fs_path)}
    if found != {f"{r}.jsonl" for r in roles}:
        raise ValueError(f"the feed holds {sorted(found)}, not exactly {sorted(f'{r}.jsonl' for r in roles)}")
    feed = {r: read_role(spark, f"{folder}/{r}.jsonl", r) for r in roles}
    rules = {"market": observation_rules(), "labels": label_rules()}
    for role, df in feed.items():
        empty_or_fail(duplicates(df, [*IDENTITY[role], "source_revision"]), f"{role}: repeated revision")
        feed[role] = checked(df, rules[role]) if role in rules else df
    return feed


def check_delistings(delistings: DataFrame, memberships: DataFrame) -> None:
    """A delisted instrument must have been a member, and its time and return come together."""
    empty_or_fail(delistings.join(memberships, "instrument_id", "left_anti").select("instrument_id"), "delisting of an unknown instrument")
    empty_or_fail(delistings.where("(delisting_time is null) <> (delisting_return is null)").select("instrument_id"), "delisting time without return or the reverse")


def canonical(payload) -> str:
    """JSON with sorted keys and no blanks; not-a-number is an error."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(payload) -> str:
    return hashlib.sha256(canonical(payload).encode()).hexdigest()


def table_digest(df: DataFrame) -> str:
    """A digest of a table's content that row order and partitioning don't change: counts and sums of row hashes, in two seeds."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).cast("string")
    got = df.agg(F.count("*").cast("string").alias("n"), wide(1).alias("a"), wide(2).alias("b")).first()
    return digest([df.select(*sorted(df.columns)).schema.simpleString(), *got])


def dump_book(tables: dict[str, DataFrame], path: str) -> dict:
    """A book as one Parquet table a kind and a manifest of their digests; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{path}/{name}")
    manifest = {"schema": "book", "version": 1, "tables": {n: table_digest(spark.read.parquet(f"{path}/{n}")) for n in sorted(tables)}}
    manifest["digest"] = digest(manifest)
    spark.createDataFrame([(canonical(manifest),)], "value string").coalesce(1).write.mode("error").text(f"{path}/manifest")
    return manifest


def load_book(spark: SparkSession, path: str, require_digest: bool = True) -> dict[str, DataFrame]:
    """The tables of a book; fails if the manifest or a table isn't what was written."""
    manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
    if set(manifest) != {"schema", "version", "tables", "digest"} or (manifest["schema"], manifest["version"]) != ("book", 1):
        raise ValueError("not a book's manifest")
    if require_digest and digest({k: v for k, v in manifest.items() if k != "digest"}) != manifest["digest"]:
        raise ValueError("the manifest was changed")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in manifest["tables"]}
    for name, df in tables.items():
        if require_digest and table_digest(df) != manifest["tables"][name]:
            raise ValueError(f"table {name} was changed")
    return tables


def append_new(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> int:
    """Append the rows whose keys the ledger does not have yet; says how many."""
    try:
        fresh = not_in_ledger(rows, spark.read.schema(rows.schema).parquet(path), keys).select(*rows.columns)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = rows
    fresh = fresh.dropDuplicates(keys)
    before = 0 if fresh is rows else _count(spark, path, rows.schema)
    fresh.write.mode("append").parquet(path)
    return _count(spark, path, rows.schema) - before


def _count(spark: SparkSession, path: str, schema: T.StructType) -> int:
    try:
        return spark.read.schema(schema).parquet(path).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


PRICE = "chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<adjclose: array<struct<adjclose: array<double>>>>>>>"


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Cached chart responses, one whole JSON file per ticker: ticker, d, adj_close of rows with a positive price."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("ticker"), F.from_json("value", PRICE).alias("j"))
    first = F.col("j.chart.result")[0]
    pairs = F.arrays_zip(first["timestamp"].alias("ts"), first["indicators"]["adjclose"][0]["adjclose"].alias("p"))
    rows = raw.select("ticker", F.explode(pairs).alias("z"))
    return rows.select("ticker", iso_date(F.col("z")["ts"]).alias("d"), F.col("z")["p"].alias("adj_close")).where("adj_close > 0")


def iso_date(epoch: Column) -> Column:
    """The UTC date of seconds since 1970."""
    return F.date_from_unix_date(F.floor(epoch / 86400).cast("int"))


def common_panel(prices: DataFrame, tickers: list[str]) -> DataFrame:
    """One column per ticker on the dates that all of them have."""
    wide = prices.join(common_dates(prices.where(F.col("ticker").isin(*tickers)), len(tickers)), "d").groupBy("d").pivot("ticker", tickers).agg(F.first("adj_close"))
    return wide.where(" and ".join(f"`{t}` is not null" for t in tickers)).orderBy("d")


def common_dates(dated: DataFrame, tickers: int, ticker: str = "ticker", date: str = "d") -> DataFrame:
    """The dates that all tickers have: partial sets first, so a date's rows never meet whole."""
    return dated.groupBy(date).agg(F.count_distinct(ticker).alias("__k")).where(F.col("__k") == tickers).select(date)


def not_in_ledger(rows: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the ledger does not have."""
    return rows.join(ledger, keys, "left_anti")


_EXAMPLE = {"string": "text", "bigint": 0, "double": 0.0, "map<string,double>": {"field": 0.0}}


def write_template(folder: str) -> list[str]:
    """One example line per role, with every key that a feed must have; returns the files."""
    made = []
    for role in ROLES:
        path = Path(folder) / f"{role}.jsonl"
        path.write_text(canonical({f.name: _EXAMPLE[f.dataType.simpleString()] for f in schema_of(role)}) + "\n")
        made.append(str(path))
    return made
