"""URL verdicts from rules and, where no rule fits, from a tree of path templates learned from labelled urls.

Segments that look variable (numbers, hex, mixtures) become wildcards at once; a segment whose node has too many
different children becomes a wildcard as well. Branches of a node whose labels do not differ significantly from their
siblings' are merged with them; a branch without labels stays by itself. A template's purity is its share of blocked
labels, smoothed towards that of the same template over all hosts, which is smoothed towards its parent's, and so on up to the host's and the whole table's; so a
host without labels is judged by what its templates are elsewhere. Templates at or above the threshold are rejected.

Pages are reduced to counts of templates first; only these are generalised, and joined back once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Different children above which a node's segments are variable, so that they become a wildcard.
MAX_CHILDREN = 30
#: Levels that are generalised before the lineage is cut.
LEVELS_AT_ONCE = 4
#: z below which a branch does not differ from its siblings; weight of the parent's purity; rejection threshold.
SIMILAR_Z, PRIOR_WEIGHT, REJECT_AT = 1.96, 4.0, 0.5
#: The contract's rules: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path`` (ties: the later in code-point order), and its verdict."""
    name = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def template(path: Column) -> Column:
    """All of the path's segments joined by ``/``, those that look variable as wildcards; ``~`` escapes others that look like one."""
    some = F.filter(F.split(path, "/"), lambda s: s != "")
    kind = lambda s: (
        F.when(s.rlike(r"^[0-9]+$"), F.lit("<n>"))
        .when(s.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.concat(F.lit("<n>."), F.regexp_extract(s, r"\.([A-Za-z]{1,5})$", 1)))
        .when(s.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("<x>"))
        .when(s.rlike(r"[0-9]"), F.lit("<m>"))
        .when(s.rlike(r"^[<*~]"), F.concat(F.lit("~"), s))
        .otherwise(s)
    )
    return F.array_join(F.transform(some, kind), "/")


def _segments(t: Column) -> Column:
    return F.filter(F.split(t, "/"), lambda s: s != "")


def generalised(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``general``: the segments of ``template``, where a node has too many children ``*`` in their place.

    From the top down, so that what lies below a wildcard counts as one branch. Only levels at which some host has so
    many different segments are gone through, however long the paths are.
    """
    at = leaves.select("host", F.posexplode(_segments(F.col("template"))).alias("level", "segment")).distinct()
    wide = at.groupBy("host", "level").agg(F.count("*").alias("n")).where(F.col("n") > MAX_CHILDREN)
    levels = sorted(r.level for r in wide.select("level").distinct().collect())  # no more than the longest path has
    grown = leaves.withColumn("general", _segments(F.col("template")))
    for i, level in enumerate(levels):
        above = F.md5(F.array_join(F.slice("general", 1, level), "/"))
        here = grown.withColumn("above", F.when(F.size("general") > level, above))
        nodes = here.where("above is not null").select("host", "above", F.element_at("general", level + 1).alias("segment")).distinct()
        wide = nodes.groupBy("host", "above").agg(F.count("*").alias("children")).where(F.col("children") > MAX_CHILDREN)
        starred = F.concat(F.slice("general", 1, level), F.array(F.lit("*")), F.slice("general", level + 2, F.greatest(F.size("general"), F.lit(1))))
        grown = here.join(wide, ["host", "above"], "left").withColumn("general", F.when(F.col("children").isNotNull(), starred).otherwise(F.col("general"))).drop("above", "children")
        if i % LEVELS_AT_ONCE == LEVELS_AT_ONCE - 1:
            grown = checkpointed(grown)
    return grown


def _keys(general: Column) -> Column:
    """A key for each node on the way from the host (an empty one) to the template; each is made of the one before."""
    return F.aggregate(general, F.array(F.lit("")), lambda keys, s: F.concat(keys, F.array(F.md5(F.concat(F.element_at(keys, -1), F.lit("/"), s)))))


def template_verdicts(leaves: DataFrame, threshold: float = REJECT_AT) -> DataFrame:
    """``host, template, general, purity, judged`` from ``host, template, n, labelled, blocked`` (one row for each lexical template)."""
    leaves = checkpointed(generalised(leaves).withColumn("keys", _keys(F.col("general"))).withColumn("leaf", F.element_at("keys", -1)).withColumn("general", F.array_join("general", "/")))
    tree = leaves.groupBy("host", "leaf").agg(F.min("keys").alias("keys"), *[F.sum(c).alias(c) for c in ("labelled", "blocked")])
    # a row for each node on the way; depth 0 is the host, and a leaf's key is its last node's
    steps = F.transform("keys", lambda k, i: F.struct(k.alias("node"), F.element_at("keys", F.greatest(i, F.lit(1))).alias("parent")))
    ways = tree.select("host", "leaf", "labelled", "blocked", F.posexplode(steps).alias("depth", "step")).select("host", "leaf", "labelled", "blocked", "depth", F.col("step.node").alias("node"), F.col("step.parent").alias("parent"))
    nodes = ways.groupBy("host", "depth", "node", "parent").agg(*[F.sum(c).alias(c) for c in ("labelled", "blocked")])
    siblings = Window.partitionBy("host", "depth", "parent")  # no more than MAX_CHILDREN rows
    others_n, others_b = (F.sum(c).over(siblings) - F.col(c) for c in ("labelled", "blocked"))
    pooled = (F.col("blocked") + others_b) / (F.col("labelled") + others_n)
    gap = F.abs(F.col("blocked") / F.col("labelled") - others_b / others_n)
    spread = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / F.col("labelled") + F.lit(1.0) / others_n))
    differs = (F.col("labelled") > 0) & (others_n > 0) & (gap > F.lit(SIMILAR_Z) * spread)
    nodes = nodes.withColumn("others_n", others_n).withColumn("merged", ~F.when((F.col("labelled") > 0) & (F.col("others_n") > 0), differs).otherwise(F.lit(True)))
    merged = Window.partitionBy("host", "depth", "parent", "merged")
    nodes = nodes.select("host", "depth", "node", *[F.when(F.col("merged"), F.sum(c).over(merged)).otherwise(F.col(c)).alias(c) for c in ("labelled", "blocked")])
    anywhere = ways.groupBy("depth", "node").agg(*[F.sum(c).alias(f"any_{c}") for c in ("labelled", "blocked")])
    n, b = leaves.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    steps = ways.select("host", "leaf", "depth", "node").join(nodes, ["host", "depth", "node"]).join(anywhere, ["depth", "node"])
    path = F.array_sort(F.collect_list(F.struct("depth", "labelled", "blocked", "any_labelled", "any_blocked")))  # a node for each depth
    elsewhere = lambda p, x: (x["any_blocked"] + p * PRIOR_WEIGHT) / (x["any_labelled"] + PRIOR_WEIGHT)
    purity = F.aggregate("path", F.lit((b + 1.0) / (n + 2.0)), lambda p, x: (x["blocked"] + elsewhere(p, x) * PRIOR_WEIGHT) / (x["labelled"] + PRIOR_WEIGHT))
    judged = steps.groupBy("host", "leaf").agg(path.alias("path")).select("host", "leaf", purity.alias("purity"))
    return leaves.join(judged, ["host", "leaf"]).select("host", "template", "general", "purity", F.when(F.col("purity") >= threshold, "block").otherwise("allow").alias("judged"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, labelled: str | None = None, page_id: str = "page_id", url: str = "url", threshold: float = REJECT_AT) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity``: a row for each row of ``pages``.

    Labels are the verdicts of the rules that fit and, where none does and ``labelled`` names a column, its values
    (true or 1: block; null: none). Null urls and urls without ``://`` have empty host and path and share one
    template. Without any label the purity is a half, which rejects at the usual threshold only if it is not above
    0.5; here it counts as allowed. Rows may repeat; other columns are not returned; an empty table gives none. Paths
    are judged by all their segments, however many.
    """
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), (F.col(labelled).cast("int") if labelled else F.lit(None).cast("int")).alias("given"))
    host, path = host_and_path(F.col("url"))
    parsed = slim.select("page_id", "given", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(rules)
    parsed = parsed.withColumn("rule", name).withColumn("ruled", verdict).withColumn("template", template(F.col("path"))).drop("url")
    label = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int")).otherwise(F.col("given"))
    leaves = parsed.groupBy("host", "template").agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("blocked"))
    leaves = checkpointed(leaves)
    any_label = leaves.where("labelled > 0").limit(1).count() > 0
    verdicts = template_verdicts(leaves, threshold if any_label else 2.0)
    return parsed.join(verdicts, ["host", "template"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), F.col("general").alias("template"), "purity")


def op5_path_template_tree(spark, sf_dir: str) -> DataFrame:
    """Contract digest of judge over all pages, with the contract's rules."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
