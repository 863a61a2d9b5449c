"""URL verdicts from a tree of path templates per host.

The segments of a path that vary (numbers, hashes, values that hardly repeat) become
wildcards. Branches of one host that cannot be told apart by their labels are merged into
a wildcard branch. A template is rejected when the smoothed share of good labels among its pages is low.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.session import materialize

DEPTH = 3
# A segment value that stands in fewer pages than this is taken for a variable one ...
MIN_SUPPORT = 2
# ... where its branch has more distinct values than this.
MAX_VALUES = 50
# Branches differ if their good shares lie this many standard errors apart.
Z = 3.0
# Weight of the overall share in a template's smoothed share, as a number of pages.
PRIOR_PAGES = 2.0
MIN_PURITY = 0.5

# Words in a host name that give pages a bad label.
BAD_HOST_WORDS = (
    "ads adserver adult bet bets betting casino escort gamble gambling lottery pills pharma poker porn sex spam track"
    " tracker viagra warez win xxx"
).split()


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/ ? #`` or the end, A-Z in lower case; null or none: empty."""
    return F.translate(
        F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule ``(verdict, host, path)`` that fits, or nulls.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally
    long rules the first in the list wins.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return text, verdict


def bad_host(host: Column) -> Column:
    """Whether a part of the host name between dots and hyphens is a bad word."""
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*[F.lit(w) for w in BAD_HOST_WORDS]))


def mask(path: Column) -> Column:
    """The first DEPTH segments, numbers and long hexadecimal values as ``*``, without a file ending."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    segments = F.slice(segments, 1, DEPTH)
    return F.transform(
        segments,
        lambda s: F.when(
            F.regexp_replace(s, r"\.[a-z]{1,5}$", "").rlike(r"^[0-9a-f]*[0-9][0-9a-f]*$|^.{40,}$|[0-9]{4,}"), F.lit("*")
        ).otherwise(F.regexp_replace(s, r"\.(?:html?|php|aspx?|jsp)$", "")),
    )


def _share(good: Column, n: Column, prior: Column) -> Column:
    return (good + prior * PRIOR_PAGES) / (n + PRIOR_PAGES)


def template_tree(pages: DataFrame) -> DataFrame:
    """``(host, masked, template, n_pages, n_labelled, n_good, purity)`` of ``pages(host, masked, good)``.

    ``good`` is 1, 0 or null. Pages are counted per host and masked path first (a partial
    aggregation, so a host with a third of all pages is some short rows); all that follows works
    on these. Level by level: a value with less than MIN_SUPPORT pages among more than
    MAX_VALUES siblings becomes ``*``; so does a labelled one whose good share is
    not Z standard errors away from its parent's. Purity is smoothed with the share of all labelled pages.
    """
    counts = pages.groupBy("host", "masked").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count("good").alias("n_labelled"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"),
    )
    counts = materialize(counts, "paths")
    nodes = counts.withColumn("template", F.col("masked"))
    sums = [F.sum(c).alias(c) for c in ("n_pages", "n_labelled", "n_good")]
    for level in range(DEPTH):
        at = F.get(F.col("template"), F.lit(level))
        head = F.slice(F.col("template"), 1, level) if level else F.array().cast("array<string>")
        keyed = nodes.withColumn("_head", head).withColumn("_value", at)
        branches = keyed.where(F.col("_value").isNotNull()).groupBy("host", "_head", "_value").agg(*sums)
        parents = branches.groupBy("host", "_head").agg(
            F.count(F.lit(1)).alias("_values"), F.sum("n_labelled").alias("_n"), F.sum("n_good").alias("_good")
        )
        judged = branches.join(parents, ["host", "_head"])
        pooled = (F.col("_good") + 0.5) / (F.col("_n") + 1.0)
        own = (F.col("n_good") + 0.5) / (F.col("n_labelled") + 1.0)
        error = F.sqrt(pooled * (1 - pooled) / F.greatest(F.col("n_labelled"), F.lit(1)))
        # Without labels nothing tells that a branch is like its labelled siblings.
        alike = (F.col("n_labelled") > 0) & (F.abs(own - pooled) <= Z * error)
        variable = (F.col("n_pages") < MIN_SUPPORT) & (F.col("_values") > MAX_VALUES)
        named = judged.select(
            "host", "_head", "_value", F.when(alike | variable, F.lit("*")).otherwise(F.col("_value")).alias("_name")
        )
        # Written, the next level starts from a table and not from all joins before it.
        nodes = materialize(
            keyed.join(named, ["host", "_head", "_value"], "left")
            .withColumn(
                "template",
                F.when(
                    F.col("_value").isNotNull(),
                    F.concat(
                        F.col("_head"),
                        F.array(F.col("_name")),
                        F.slice(F.col("template"), level + 2, DEPTH),
                    ),
                ).otherwise(F.col("template")),
            )
            .drop("_head", "_value", "_name"),
            "nodes",
        )
    overall = counts.agg(((F.sum("n_good") + 1.0) / (F.sum("n_labelled") + 1.0)).alias("share")).first()["share"]
    templates = nodes.groupBy("host", "template").agg(*sums)
    templates = templates.withColumn(
        "purity", _share(F.col("n_good"), F.col("n_labelled"), F.lit(1.0 if overall is None else overall))
    )
    return nodes.select("host", "masked", "template").join(templates, ["host", "template"])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict, template, purity)`` of every row of ``pages(page_id, url)``.

    A page has a label if a rule decides it, if its host has a bad word, or if ``labels(url, good)`` names its URL.
    ``verdict`` is the rule's, else ``block`` if the page's template has labels and a
    purity below MIN_PURITY, else ``allow``.
    Null URLs and such without ``://`` have an empty host and path and are one template; null ids stay; repeated rows count each and
    give a row each; no rows give no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, decision = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("_decision", decision).withColumn("masked", mask(F.col("path")))
    good = F.when(F.col("_decision") == "allow", 1).when(F.col("_decision") == "block", 0).when(bad_host(F.col("host")), 0)
    labelled = parsed
    if labels is not None:
        given = labels.groupBy("url").agg(F.max("good").alias("_given"))
        labelled = parsed.join(given, "url", "left")
        good = F.coalesce(F.col("_given"), good)
    tree = template_tree(labelled.select("host", "masked", good.alias("good")))
    judged = parsed.join(tree.select("host", "masked", "template", "n_labelled", "purity"), ["host", "masked"])
    impure = (F.col("n_labelled") > 0) & (F.col("purity") < MIN_PURITY)
    by_method = F.when(impure, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id",
        "url",
        "host",
        "path",
        "rule",
        F.coalesce("_decision", by_method).alias("verdict"),
        F.concat(F.col("host"), F.lit("/"), F.array_join("template", "/")).alias("template"),
        "purity",
    )
