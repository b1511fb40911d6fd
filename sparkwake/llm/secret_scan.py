"""Secret scans: base patterns, then weak parts that count only where they complete each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

# The base patterns, and the parts that the linking step may add.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
WEAK_ACCESS = r"(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}"
WEAK_SECRET = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
#: What counts as an identifier, and as a secret, when parts are linked.
IDS, SECRETS = ("access", "weak_access"), ("assign", "hex", "weak_secret")
MIN_VALUE = 8
#: Code points between two parts that may still belong together.
SCOPE = 200

_SPANS = "array<struct<start:int,stop:int>>"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def spans(text: str, pattern: str, where: Column, value_group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as code-point spans: lengths of matches and of what lies between, summed."""
    value = f", regexp_extract_all({text}, '{_quoted(pattern)}', {value_group})" if value_group else ""
    lens = f"transform(regexp_extract_all({text}, '{_quoted(pattern)}', 0), x -> length(x))"
    gaps = f"transform(split({text}, '{_quoted(pattern)}', -1), x -> length(x))"
    zipped = f"arrays_zip({lens}, {gaps}{value})"
    found = (
        f"aggregate(filter({zipped}, z -> z.`0` is not null), named_struct('at', 0, 'out', cast(array() as {_SPANS})),"
        f" (a, z) -> named_struct('at', a.at + z.`1` + z.`0`, 'out', "
        + (f"if(length(z.`2`) < {MIN_VALUE}, a.out, " if value_group else "(")
        + "concat(a.out, array(named_struct('start', a.at + z.`1`, 'stop', a.at + z.`1` + z.`0`))))), a -> a.out)"
    )
    return F.when(where, F.expr(found)).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _link(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Interval join within a text: the weak parts that lie within SCOPE of their counterparts.

    Parts are sorted by start. The counterparts before a part reach it if the furthest of their ends does, those
    after it if the first of their starts does; so one running maximum from either side replaces all pairs.
    """
    rising = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    falling = Window.partitionBy(*keys).orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def near(kinds: tuple[str, ...]) -> Column:
        meant = F.col("kind").isin(*kinds)
        end, start = F.max(F.when(meant, F.col("stop"))).over(rising), F.min(F.when(meant, F.col("start"))).over(falling)
        return F.coalesce(end >= F.col("start") - SCOPE, F.lit(False)) | F.coalesce(start <= F.col("stop") + SCOPE, F.lit(False))

    reached = parts.withColumns({"by_id": near(IDS), "by_secret": near(SECRETS)})
    return reached.where(
        (F.col("kind") == "weak_access") & F.col("by_secret")
        | (F.col("kind") == "weak_secret") & F.col("by_id")
        | (F.col("kind") == "endpoint") & F.col("by_id") & F.col("by_secret")
    ).drop("by_id", "by_secret")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every text.

    assign, access and hex are reported always. Temporary or role identifiers (weak_access), 40-character base64
    strings without a key name (weak_secret) and service addresses (endpoint) are weak: an identifier or a
    secret is reported only with its counterpart within SCOPE code points, an address only with both. The scope of the interval
    join is a text; only parts of texts with weak ones are shuffled, never texts.

    Nulls count as empty texts and have no spans; very long texts are matched as a whole, in the JVM; rows that repeat are scanned
    each, and their parts linked once; other columns are ignored.

    Returns doc_id, n_assign, n_access, n_hex, base (spans of the base kinds), found (all spans), each span a struct of
    start, rank, stop, kind, in code points and by start, then kind.
    """
    t, keys = "__text", ["doc_id", "key", "size"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias(t))
    has = lambda pattern: F.col(t).rlike(pattern)
    marked = rows.select(
        "doc_id",
        F.xxhash64(t).alias("key"),
        F.octet_length(t).alias("size"),
        t,
        spans(t, ASSIGN, has(ASSIGN), 2).alias("assign"),
        spans(t, ACCESS, F.col(t).contains("AKIA") & has(ACCESS)).alias("access"),
        spans(t, HEX, has(HEX)).alias("hex"),
        spans(t, WEAK_ACCESS, (F.col(t).contains("ASIA") | F.col(t).contains("AROA") | F.col(t).contains("AIDA")) & has(WEAK_ACCESS)).alias("weak_access"),
    )
    some_id = (F.size("access") > 0) | (F.size("weak_access") > 0)
    marked = materialise(
        marked.select("*", spans(t, WEAK_SECRET, some_id).alias("weak_secret"), spans(t, ENDPOINT, some_id).alias("endpoint")).drop(t)
    )
    named = lambda kind: F.expr(
        f"transform({kind}, s -> struct(s.start as start, {KINDS.index(kind)} as rank, s.stop as stop, '{kind}' as kind))"
    )
    some_weak = F.size("weak_access") + F.size("weak_secret") + F.size("endpoint") > 0
    parts = marked.where(some_weak).select(*keys, F.explode(F.concat(*[named(k) for k in KINDS])).alias("s")).select(*keys, "s.*").distinct()
    linked = _link(parts, keys).groupBy(*keys).agg(F.collect_list(F.struct("start", "rank", "stop", "kind")).alias("added"))
    linked = linked.withColumnsRenamed({c: f"__{c}" for c in keys})
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("key") == F.col("__key")) & (F.col("size") == F.col("__size"))
    base = F.concat(*[named(k) for k in KINDS[:3]])
    counted = ["doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.array_sort(base).alias("base")]
    plain = marked.where(~some_weak).select(*counted, F.array_sort(base).alias("found"))
    richer = marked.where(some_weak).join(linked, same, "left").select(
        *counted, F.array_sort(F.when(F.col("added").isNull(), base).otherwise(F.concat(base, F.col("added")))).alias("found")
    )
    return plain.unionByName(richer)


def joined(found: str) -> Column:
    """Spans as one string: kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({found}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')")
