"""URL filters: allow and block rules by host and path, then association rules mined from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, materialise

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
SALTS = 16
#: What stands where no rule and no mined rule speaks.
DEFAULT = "allow"

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (verdict, host, path) that fits the host or a parent of it, as struct(rule, verdict)."""
    fitting = [
        F.when(
            ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path),
            F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    ]
    return F.coalesce(*fitting)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, by the part they stand in; digits in a path segment become #."""
    parts = lambda text, pattern: F.filter(F.split(text, pattern), lambda x: x != "")
    tagged = lambda items, tag: F.transform(items, lambda x: F.concat(F.lit(tag), x))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    return F.array_distinct(
        F.concat(
            tagged(parts(host, r"\."), "h:"),
            tagged(F.transform(parts(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#")), "p:"),
            tagged(F.transform(parts(query, "&"), lambda x: F.substring_index(x, "=", 1)), "q:"),
            F.when(url.startswith("https://"), F.array(F.lit("s:https"))).otherwise(F.array(F.lit("s:other"))),
        )
    )


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Association rules tokens -> label from labelled(tokens, label).

    Spark's parallel FP-growth counts token sets together with the label as one more item; rules with a
    label on the right that reach both bounds stay, unless a part of their left side alone is as confident.
    Returns rule (tokens), label, confidence, support, anchor (the rarest token of the rule).
    """
    tag = "label="
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(tag), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.expr(f"size(consequent) = 1 and startswith(consequent[0], '{tag}')")).select(
        F.array_sort("antecedent").alias("rule"), F.expr(f"substr(consequent[0], {len(tag) + 1})").alias("label"), "confidence", "support"
    ).where(F.expr(f"not exists(rule, t -> startswith(t, '{tag}'))"))
    freq = model.freqItemsets.where("size(items) = 1").select(F.expr("items[0]").alias("t"), "freq")
    rules = materialise(rules)
    parts = rules.select("rule", "label", "confidence", F.explode("rule").alias("t"))
    general = parts.select("label", "rule", F.array_sort(F.array_except("rule", F.array("t"))).alias("part"), F.col("confidence").alias("own"))
    weaker = general.join(
        rules.select("label", F.col("rule").alias("part"), F.col("confidence").alias("general")), ["label", "part"]
    ).where("general >= own").select("rule", "label").distinct()
    anchors = parts.join(freq, "t").groupBy("rule", "label").agg(F.min_by("t", F.struct("freq", "t")).alias("anchor"))
    return materialise(rules.join(weaker, ["rule", "label"], "left_anti").join(anchors, ["rule", "label"]))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
          min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """A verdict for every URL: the longest fitting rule's, else that of the most confident mined rule.

    URLs that a rule fits are the labels from which token combinations are mined. URLs with the same known
    tokens share one look-up: each such token set meets, through an inverted index on the rules' rarest
    tokens, the mined rules it contains. Ties go to support, then block, then the tokens by code point. Only tokens of
    mined rules are known; their number is bounded by tokens per URL / min_support.

    A null or malformed URL has empty host and path and gets the default verdict; rows that repeat are judged
    each; other columns are ignored; with no labelled URL every verdict is a rule's or the default.

    Returns page_id, host, path, rule, verdict, by (rule, mined or default), confidence.
    """
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = materialise(
        parsed.select(
            "page_id", "host", "path", by_rules(F.col("host"), F.col("path"), rules).alias("fit"),
            F.when(F.col("host") == "", F.expr("cast(array() as array<string>)")).otherwise(tokens_of(F.col("url"), F.col("host"), F.col("path"))).alias("tokens"),
        )
    )
    labelled = judged.where("fit is not null").select("tokens", F.col("fit.verdict").alias("label"))
    if labelled.isEmpty():
        return judged.select(
            "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(DEFAULT)).alias("verdict"),
            F.when(F.col("fit").isNull(), "default").otherwise("rule").alias("by"), F.lit(None).cast("double").alias("confidence"),
        )
    mined = mine(labelled, min_support, min_confidence)
    known = [r["t"] for r in mined.select(F.explode("rule").alias("t")).distinct().orderBy("t").collect()]
    vocabulary = F.array(*[F.lit(t) for t in known]) if known else F.expr("cast(array() as array<string>)")
    keyed = judged.withColumns({
        "sig": F.array_sort(F.array_intersect("tokens", vocabulary)),
        "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)),
    })
    sets = keyed.where("fit is null").select("sig").distinct()
    index = mined.select("anchor", "rule", "label", "confidence", "support")
    best = (
        sets.select("sig", F.explode("sig").alias("anchor"))
        .join(index, "anchor")
        .where(F.size(F.array_except("rule", "sig")) == 0)
        .groupBy("sig")
        .agg(F.max_by(F.struct("label", "confidence"), F.struct("confidence", "support", "label", "rule")).alias("best"))
        .select("sig", "best", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    )
    return keyed.join(best, ["sig", "salt"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "best.label", F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("fit").isNotNull(), "rule").when(F.col("best").isNotNull(), "mined").otherwise("default").alias("by"),
        F.when(F.col("fit").isNull(), F.col("best.confidence")).alias("confidence"),
    )
