"""URL filters: rules first, then a tree of path templates, in DataFrame operations only.

URLs that a rule decides are the labels. Paths are generalised: numbers and other machine-made segments become wildcards by their
form; then, from the root down, a branch of a host becomes the wildcard of its parent if its labels do not differ significantly from its
siblings' (similar branches are merged). A rare branch of a node with many children that has no labels to compare does so unless
those of the same template over all hosts differ. A template
is rejected if the share of blocked labels, smoothed towards the same template over all hosts and that towards its parent, is
above a half.

Statistics are sums over (host, generalised path), which are combined before any shuffle, so a host with a third of all pages is a few
rows. Pages are joined with templates as plain tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import lower_ascii, table
from txnrisk.session import materialise

# Rules of the registered query, (verdict, host and path prefix).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Most levels of the tree, more than a URL of 2,000 bytes has; deeper segments are one last wildcard. Only levels that occur are built.
DEPTH = 1_000
#: Children with a smaller share of the pages of a node with more children than this are rare.
MANY, SHARE = 20, 0.02
#: Standard errors by which a branch must differ from its parent to stay apart.
SIGNIFICANT = 1.96
#: Labels that the smoothing prior counts for.
PRIOR = 4.0
#: Marks of generalised segments.
ANY, REST = "*", "**"


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits the host or a parent domain and the start of the path; null if none does."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):  # a longer rule is asked first
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def generalised() -> Column:
    """The segments of column path, numbers and machine-made names replaced by the form they have."""
    simple = (
        "transform(array_remove(split(path, '/', -1), ''), s -> CASE WHEN s rlike '^[0-9]+$' THEN '<n>'"
        r" WHEN s rlike '^[0-9]+\\.[A-Za-z]+$' THEN concat('<n>', regexp_extract(s, '\\.[A-Za-z]+$', 0))"
        " WHEN s rlike '^[0-9a-fA-F-]{16,}$' THEN '<x>' WHEN length(s) > 48 THEN '<long>' ELSE s END)"
    )
    segments = F.expr(simple)
    return F.when(F.size(segments) > DEPTH, F.concat(F.slice(segments, 1, DEPTH), F.array(F.lit(REST)))).otherwise(segments)


def _differ(blocked: str, labelled: str, node_blocked: str, node_labelled: str) -> Column:
    """Whether the labels of a branch differ significantly from those of its siblings; null without labels on both sides."""
    own, all_, rest = F.col(labelled), F.col(node_labelled), F.col(node_labelled) - F.col(labelled)
    pooled = F.try_divide(F.col(node_blocked).cast("double"), all_)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), own) + F.try_divide(F.lit(1.0), rest)))
    gap = F.abs(F.try_divide(F.col(blocked).cast("double"), own) - F.try_divide((F.col(node_blocked) - F.col(blocked)).cast("double"), rest))
    return F.when((own > 0) & (rest > 0), F.coalesce(gap, F.lit(0.0)) > SIGNIFICANT * F.coalesce(error, F.lit(0.0)))


def template_tree(paths: DataFrame) -> DataFrame:
    """host, segments, template of distinct generalised paths with their sums n, blocked, labelled.

    Level by level: the children of every node are compared with the node; those whose labels do not differ, and rare ones of many
    that nothing tells apart, become one wildcard. A node of a single path keeps the rest of it, so levels end where paths still meet.
    """
    sums = ("n", "blocked", "labelled")
    tree = paths.withColumn("template", F.array().cast("array<string>"))
    for level in range(DEPTH):
        child = F.get(F.col("segments"), F.lit(level))
        placed = tree.withColumn("child", child)
        deeper = placed.filter("child is not null and size(template) = " + str(level))
        kids = deeper.groupBy("host", "template", "child").agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("paths"))
        kids = materialise(kids, "url-kids")
        if kids.isEmpty():
            break
        nodes = kids.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("paths").alias("node_paths"), *[F.sum(c).alias(f"node_{c}") for c in sums])
        # The same branch over all hosts.
        wide = kids.groupBy("template", "child").agg(F.sum("blocked").alias("w_blocked"), F.sum("labelled").alias("w_labelled")).withColumnsRenamed({"template": "w_template", "child": "w_child"})
        wide_nodes = kids.groupBy(F.col("template").alias("v_template")).agg(F.sum("blocked").alias("v_blocked"), F.sum("labelled").alias("v_labelled"))
        wide = wide.join(wide_nodes, F.col("w_template") == F.col("v_template")).select("w_template", "w_child", _differ("w_blocked", "w_labelled", "v_blocked", "v_labelled").alias("w_differs"))
        both = kids.withColumnsRenamed({"host": "k_host", "template": "k_template"}).join(nodes.withColumnsRenamed({"host": "p_host", "template": "p_template"}), (F.col("k_host") == F.col("p_host")) & (F.col("k_template") == F.col("p_template")))
        rare = (F.col("kids") > MANY) & (F.col("n") < F.col("node_n") * SHARE)
        # Without labels on both sides there is no sign of a difference, but a branch of its own form keeps the path's shape.
        both = both.withColumn("rare", rare).withColumn("differs", _differ("blocked", "labelled", "node_blocked", "node_labelled"))
        both = both.join(wide, (F.col("k_template") == F.col("w_template")) & (F.col("child") == F.col("w_child")), "left")
        merged = F.when(F.col("differs").isNotNull(), ~F.col("differs")).otherwise(F.col("rare") & ~F.coalesce("w_differs", F.lit(False)))
        named = both.select("k_host", "k_template", F.col("child").alias("k_child"), F.when(merged, ANY).otherwise(F.col("child")).alias("name"), (F.col("node_paths") == 1).alias("alone"))
        joined = placed.join(named, (placed["host"] == named["k_host"]) & (placed["template"] == named["k_template"]) & (placed["child"] == named["k_child"]) & (F.size(placed["template"]) == level), "left")
        rest = F.expr(f"slice(segments, {level + 1}, {DEPTH})")  # without the mark of deeper segments
        template = F.when(F.col("name").isNull(), F.col("template")).when(F.col("alone"), F.concat("template", rest)).otherwise(F.concat("template", F.array("name")))
        tree = materialise(joined.select("host", "segments", template.alias("template"), *sums), "url-tree")
    deep = F.size("segments") > DEPTH
    return tree.withColumn("template", F.when(deep, F.concat(F.slice("template", 1, DEPTH), F.array(F.lit(REST)))).otherwise(F.col("template")))


def template_purity(tree: DataFrame, prior: float = PRIOR) -> DataFrame:
    """host, template, purity: the smoothed share of blocked labels of every template of every host."""
    total = tree.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    root = ((total["b"] or 0) + 1.0) / ((total["l"] or 0) + 2.0)
    shared = tree.groupBy("template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    known = materialise(shared, "url-templates")
    purity, level, size = None, None, 0
    while True:
        # Sums of everything below each node of this depth; a node of a single template is followed to its end at once.
        nodes = known.filter(F.size("template") >= size).groupBy(F.slice("template", 1, size).alias("node") if size else F.array().cast("array<string>").alias("node"))
        nodes = nodes.agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.count("*").alias("below"), F.max("template").alias("full"))
        if level is None:
            joined = nodes.withColumn("parent_purity", F.lit(root))
        else:
            parents = level.select(F.col("node").alias("parent"), F.col("purity").alias("parent_purity"))
            joined = nodes.join(parents, F.slice("node", 1, size - 1) == F.col("parent") if size > 1 else F.size("parent") == 0)
        steps = F.when(F.col("below") == 1, F.size("full") - size + 1).otherwise(1)
        smoothed = F.aggregate(F.sequence(F.lit(1), steps), F.col("parent_purity"), lambda p, _: (F.col("blocked") + prior * p) / (F.col("labelled") + prior))
        own_node = F.when(F.col("below") == 1, F.col("full")).otherwise(F.col("node"))
        found = materialise(joined.select(own_node.alias("node"), smoothed.alias("purity"), "below"), "url-purity")
        purity = found if purity is None else purity.unionAll(found)
        level = found.filter("below > 1")
        if level.isEmpty():
            break
        size += 1
    own = tree.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    joined = own.join(purity.select("node", F.col("purity").alias("shared_purity")), F.col("template") == F.col("node"))
    return joined.select("host", "template", ((F.col("blocked") + prior * F.col("shared_purity")) / (F.col("labelled") + prior)).alias("purity"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, prior: float = PRIOR) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict, template, purity.

    A URL that is null or has no "://" has an empty host and path and is judged like any other. The verdict is the rule's, else "block" if the
    smoothed purity of the page's template is above 0.5, else "allow"; without any labels everything else is allowed. Repeated rows
    get equal results; an empty table gives an empty result. Only page_id and url are read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    verdicts = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdicts = F.when(F.col("rule") == rule, verdict).otherwise(verdicts)
    split = split.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("told", verdicts)
    marked = split.withColumn("segments", generalised())
    sums = marked.groupBy("host", "segments").agg(F.count("*").alias("n"), F.sum((F.col("told") == "block").cast("long")).alias("blocked"), F.count("told").alias("labelled"))
    tree = template_tree(materialise(sums.withColumn("blocked", F.coalesce("blocked", F.lit(0).cast("long"))), "url-paths"))
    purity = template_purity(tree, prior).withColumnsRenamed({"host": "p_host", "template": "p_template"})
    known = tree.join(purity, (tree["host"] == purity["p_host"]) & (tree["template"] == purity["p_template"]))
    known = materialise(known.select(F.col("host").alias("k_host"), F.col("segments").alias("k_segments"), "template", "purity"), "url-known")
    out = marked.join(known, (marked["host"] == known["k_host"]) & (marked["segments"] == known["k_segments"]), "left")
    verdict = F.coalesce("told", F.when(F.col("purity") > 0.5, "block").otherwise("allow"))
    shown = F.concat(F.lit("/"), F.array_join("template", "/"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), shown.alias("template"), F.round("purity", 6).alias("purity"))


def op2_url_filter(spark, sf_dir):
    return judged(table(spark, sf_dir, "pages"), RULES)


QUERIES = {"op2_url_filter": op2_url_filter}
ORACLE = {}
