"""URL filters: given rules, and path templates judged by labelled pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.llm.common import column, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Segments below this depth form one open tail in the tree.
MAX_DEPTH = 8
# A place in a path is variable if it shows so many values, and one for every so many urls.
VARIABLE_VALUES, VARIABLE_SHARE = 20, 0.05
# A value that holds this share of the urls of its place stays a branch of its own.
FREQUENT_SHARE = 0.05
# Chi-square of one degree of freedom up to which two bad shares count as alike (5 %).
ALIKE = 3.84
VARIABLE, MERGED, TAIL = "*", "+", "**"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty if there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    A rule is ``(verdict, host/path)``; it fits its host and all subdomains where the url's path
    starts with its path. Of equally long rules the first in the order of the alphabet wins.
    """
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def shape(path: Column) -> Column:
    """The segments of a path, with long hexadecimal names and numbers made alike."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    plain = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, "(?i)[0-9a-f]{16,}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "{h}"), "[0-9]+", "{n}"))
    return F.when(F.size(plain) > MAX_DEPTH, F.concat(F.slice(plain, 1, MAX_DEPTH), F.array(F.lit(TAIL)))).otherwise(plain)


def _chi(bad: Column, n: Column, all_bad: Column, all_n: Column) -> Column:
    """Chi-square between a branch and the other branches of its place; 0 where it can't be told."""
    share, rest = F.try_divide(all_bad, all_n), all_n - n
    apart = F.try_divide(bad, n) - F.try_divide(all_bad - bad, rest)
    spread = share * (1 - share) * (F.try_divide(F.lit(1), n) + F.try_divide(F.lit(1), rest))
    return F.coalesce(F.try_divide(apart * apart, spread), F.lit(0.0))


def templates(urls: DataFrame) -> DataFrame:
    """``(host, shape, template, n, labelled, bad)`` per host and shape, from ``(host, shape, bad)``.

    ``bad`` is null where a url is not labelled. From the root of each host downwards, a place
    with many values becomes a wildcard, but for values that hold a good part of it; then the
    branches whose bad share does not differ from that of the others of their place are merged.
    What lies below merged branches meets in the next step. Each step is an aggregation over
    ``(host, template so far, value)``, combined before the shuffle, so a host with a third of
    all urls is one row per task and value.
    """
    leaves = written(
        urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("bad"))
        .withColumn("template", F.lit("")),
        "shapes",
    )
    depth = leaves.agg(F.max(F.size("shape"))).first()[0] or 0
    for d in range(depth):
        at = leaves.withColumn("value", F.try_element_at("shape", F.lit(d + 1)))
        place = ["host", "template"]
        values = at.filter("value IS NOT NULL").groupBy(*place, "value").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        places = values.groupBy(*place).agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("n_values"))
        variable = (F.col("n_values") >= VARIABLE_VALUES) & (F.col("n_values") >= F.col("all_n") * VARIABLE_SHARE) & (F.col("n") < F.col("all_n") * FREQUENT_SHARE)
        named = written(values.join(places, place).withColumn("branch", F.when(variable, VARIABLE).otherwise(F.col("value"))), "values")
        branches = named.groupBy(*place, "branch").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        sums = branches.groupBy(*place).agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"), F.count(F.lit(1)).alias("n_branches"))
        merged = branches.join(sums, place).select(
            *place, "branch",
            F.when((F.col("n_branches") > 1) & (_chi(F.col("b"), F.col("l"), F.col("all_b"), F.col("all_l")) <= ALIKE), MERGED).otherwise(F.col("branch")).alias("name"),
        )
        steps = named.select(*place, "value", "branch").join(merged, [*place, "branch"]).select(*place, "value", "name")
        leaves = written(
            at.join(steps, [*place, "value"], "left").withColumn("template", F.concat("template", F.when(F.col("name").isNull(), "").otherwise(F.concat(F.lit("/"), "name")))).drop("value", "name"),
            "shapes",
        )
    return leaves


def judge(leaves: DataFrame, max_bad: float, weight: float) -> DataFrame:
    """``(host, shape, template, bad_share)`` of the templates to reject.

    The bad share of a template is smoothed towards that of its host, and the host's towards
    that of all pages, each with the weight of ``weight`` pages; without labels of its own a
    template is not rejected.
    """
    every = leaves.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("of_all"))
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    hosts = hosts.join(F.broadcast(every)).select("host", ((F.col("b") + weight * F.col("of_all")) / (F.col("l") + weight)).alias("of_host"))
    shares = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).filter("l > 0").join(hosts, "host")
    bad = shares.select("host", "template", ((F.col("b") + weight * F.col("of_host")) / (F.col("l") + weight)).alias("bad_share")).filter(F.col("bad_share") > max_bad)
    return leaves.select("host", "template", "shape").join(bad, ["host", "template"])


def filter_urls(
    pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = (), max_bad: float = 0.35, weight: float = 20.0,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``template``, the
    rejected template that a url fell under (else null).

    ``labelled`` holds ``(url, bad)``. Where a rule fits, its verdict holds; elsewhere a url is
    blocked if its template is rejected. A null url, or one without ``://``, has an empty host
    and path and is judged as a host of that name; without labels nothing is rejected. Ids may
    be null or repeat; rows are never merged; other columns are not read.
    """
    host, path = host_and_path(column(url_col).cast("string"))
    split = pages.select(column(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("shape", shape(F.col("path")))
    l_host, l_path = host_and_path(F.col("url"))
    known = labelled.filter("bad IS NOT NULL").select(l_host.alias("host"), shape(l_path).alias("shape"), F.col("bad").cast("boolean").alias("bad"))
    seen = split.select("host", "shape", F.lit(None).cast("boolean").alias("bad")).unionByName(known)
    rejected = written(judge(templates(seen), max_bad, weight), "rejected")
    rule, says = rule_column(rules, F.col("host"), F.col("path"))
    return split.join(rejected, ["host", "shape"], "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(says, F.when(F.col("template").isNotNull(), "block").otherwise("allow")).alias("verdict"), "template",
    )
