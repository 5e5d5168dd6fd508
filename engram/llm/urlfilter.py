"""URL filters: per host a tree of path templates, merged where branches look alike and judged by labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.shared import discard, materialise

#: A segment that looks like a number, a date, a hash or a UUID, with a file ending or without.
VARIABLE = r"^(\d[\d_.-]*|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(\.\w{1,5})?$"

SALTS = 16


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end. Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, "host/path") that fits, and its verdict; null without one. The list is configuration, not data."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url", min_support: int = 8,
    fanout: int = 24, z: float = 1.96, prior: float = 4.0, lift: float = 2.0, min_labelled: int = 8,
) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict, template, bad_share.

    labels: (id, bad), bad 0 or 1. The segments of paths are the levels of a tree for each host, as many as the longest path
    has. At each level, from the root on:
    1. a node that fewer than min_support pages go beyond isn't divided: what follows is /**;
    2. a segment that looks like an identifier becomes *, and so does one with fewer than min_support pages whose parent
       has more than fanout different ones;
    3. of what is left, the branches whose labelled share of bad pages is within z standard errors of their siblings'
       share are merged into *, if there are two or more of them. A branch that differs stays, and so does a single one that doesn't.
    A template is blocked if at least min_labelled of its pages have labels and its share of bad ones, smoothed by prior
    pages at the share of the whole table, is over lift times that share. Rules go before templates.

    Each level is written and read again: it is used for its counts and for the next one. Counts are summed before they
    move, and each is dealt out to SALTS tasks for the joins, so neither a host with most of the pages nor one template of it is
    in one task. Null urls and those without :// have empty host and path. Labels of unknown pages count for nothing; of
    several labels of a page the worst counts. Repeated rows stay and count. Empty: empty.
    """
    host, path = url_parts(F.col(url_col))
    judged = labels.where("bad IS NOT NULL").groupBy(F.col(labels.columns[0]).alias("_id")).agg(F.max("bad").alias("_bad"))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).join(judged, F.col(id_col) == F.col("_id"), "left").drop("_id")
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    rows = rows.withColumn("_parts", parts).withColumn("template", F.lit("")).withColumn("_salt", F.pmod(F.xxhash64(id_col, "path"), F.lit(SALTS)).cast("int"))
    rows, level = materialise(rows, "url-levels"), 0
    while not rows.where(F.size("_parts") > level).isEmpty():
        further = materialise(_generalise(rows, level, min_support, fanout, z), "url-levels")
        discard(rows)
        rows, level = further, level + 1
    sums = rows.groupBy("host", "template").agg(F.count("_bad").alias("_n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("_k"))
    share = F.coalesce(judged.agg(F.avg("_bad")).scalar(), F.lit(0.0))
    smooth = (F.col("_k") + share * prior) / (F.col("_n") + prior)
    sums = sums.select("host", "template", smooth.alias("bad_share"), ((F.col("_n") >= min_labelled) & (smooth > lift * share)).alias("_reject"))
    rows = _dealt(rows.drop("_bad", "_parts"), sums, ["host", "template"])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    of_template = F.when(F.col("_reject"), "block").otherwise("allow")
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, of_template).alias("verdict"), "template", "bad_share")


def _dealt(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows, which have a _salt, joined from the left with few, of which each row goes to every salt."""
    return rows.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"], "left")


def _generalise(rows: DataFrame, level: int, min_support: int, fanout: int, z: float) -> DataFrame:
    """Appends this level's segment, or *, to the templates; the rows of nodes that aren't divided have no further parts."""
    segment = F.when(F.size("_parts") > level, F.col("_parts")[level])
    rows = rows.withColumn("_segment", F.when(segment.rlike(VARIABLE), "*").otherwise(segment))
    key = ["host", "template"]
    counts = rows.where("_segment IS NOT NULL").groupBy(*key, "_segment").agg(F.count("*").alias("pages"), F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("k"))
    named = F.col("_segment") != "*"
    of_named = lambda f, c: f(F.when(named, c))
    parents = counts.groupBy(*key).agg(F.sum("pages").alias("beyond"), of_named(F.count, F.lit(1)).alias("kinds"), of_named(F.sum, F.col("n")).alias("all_n"), of_named(F.sum, F.col("k")).alias("all_k"))
    branch = _dealt(counts.withColumn("_salt", F.pmod(F.xxhash64("_segment"), F.lit(SALTS)).cast("int")), parents, key)
    rest_n, rest_k = F.col("all_n") - F.col("n"), F.col("all_k") - F.col("k")
    p = (F.col("all_k") + 1) / (F.col("all_n") + 2)
    error = F.sqrt(p * (1 - p) * (1 / F.greatest(F.col("n"), F.lit(1)) + 1 / F.greatest(rest_n, F.lit(1))))
    differs = F.abs(F.col("k") / F.greatest(F.col("n"), F.lit(1)) - rest_k / F.greatest(rest_n, F.lit(1))) > z * error
    rare = named & (F.col("pages") < min_support) & (F.col("kinds") > fanout)
    alike = named & (F.col("kinds") > 1) & ~((F.col("n") > 0) & (rest_n > 0) & differs)
    branch = branch.select(*key, "_segment", "_salt", (F.col("beyond") < min_support).alias("_end"), rare.alias("_rare"), alike.alias("_alike"))
    several = branch.groupBy(*key).agg((F.count_if(F.col("_alike") & ~F.col("_rare")) > 1).alias("_several"))
    branch = _dealt(branch, several, key).select(*key, "_segment", "_end", (F.col("_rare") | (F.col("_alike") & F.col("_several"))).alias("_wild"))
    rows = _dealt(rows, branch, [*key, "_segment"])
    part = F.when(F.col("_segment").isNull(), F.lit("")).when(F.col("_end"), F.lit("/**")).when(F.col("_wild"), F.lit("/*")).otherwise(F.concat(F.lit("/"), F.col("_segment")))
    left = F.when(F.coalesce("_end", F.lit(False)), F.array().cast("array<string>")).otherwise(F.col("_parts"))
    return rows.withColumn("template", F.concat("template", part)).withColumn("_parts", left).drop("_segment", "_wild", "_end")
