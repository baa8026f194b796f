"""Personal data by rules and by bootstrapped contexts, in DataFrame operations only.

Rules find the base spans: e-mail and IP addresses, card and phone numbers. They are seeds, and so are tokens in the form of a secret, long runs of
mixed letters and digits. The words around a seed are its
lexical patterns; other tokens that look like identifiers (they hold a digit or an @) and stand in the same patterns are
instances. Patterns and instances form a graph that is scored in rounds: a pattern by the share of known values among its
distinct values, an instance by the patterns that it stands in; instances above the threshold are known in the next round, until
no round finds another. What stands in a confident pattern and is known by then is a span: a secret if it has that form, else an
identifier. Form alone makes no span.

A span's place is the length of the gaps and matches before it. Only matches with a few words around them leave the scan of the
texts. Every regular expression runs in time linear in the text: runs are possessive and start where a run starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.llm.common import table
from txnrisk.session import materialise

# Kinds in output order, with the pattern of each; `\G` lets a match start where the last one ended.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a text holds no match.
MAYBE = {"email": "contains(text, '@')", "ip": r"text rlike '[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]'", "card": r"text rlike '[0-9](?:[ -]?[0-9]){15}'", "phone": r"text rlike '\\+[0-9]'"}
#: Tokens that look like identifiers.
TOKEN = r"(?<![A-Za-z0-9._%+@#/-])(?=[A-Za-z._%+#/-]*+[0-9@])[A-Za-z0-9._%+@#/-]{4,}+"
#: Characters kept on either side of a match, to find its neighbouring words.
AROUND = 60
#: Distinct known values that a pattern needs, its share of them, and the score that makes an instance known.
SUPPORT, CONFIDENCE, ACCEPT = 5, 0.8, 0.8
#: Kinds of the spans that the method adds, and the form of a secret: characters, and letters and digits among them.
ADDED = ("secret", "identifier")
SECRET_CHARS, SECRET_MIX = 20, 4


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _secret(hit: Column) -> Column:
    digits = F.length(_digits(hit))
    return hit.rlike(f"^[A-Za-z0-9]{{{SECRET_CHARS},}}$") & (digits >= SECRET_MIX) & (F.length(hit) - digits >= SECRET_MIX)


def _valid(kind: Column, hit: Column) -> Column:
    digits = _digits(hit)
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(kind == "ip", hit.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(kind == "card", F.length(digits).between(16, 19) & _luhn(digits))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(F.lit(True))
    )


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit counts double, with its digits added."""
    back = F.reverse(F.substring(digits, 1, 19))
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), lambda i: F.try_element_at(F.split(back, ""), i).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(F.when(v > 9, v - 9).otherwise(v), F.lit(0)))
    return (F.length(back) > 0) & (total % 10 == 0)


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _found(kind: str, pattern: str, maybe: str) -> str:
    """SQL for kind, gaps (texts before, between and after the matches) and hits of a text, null if there is none."""
    literal = pattern.replace("\\", "\\\\")
    return f"if({maybe}, struct('{kind}' AS kind, split(text, '{literal}', -1) AS gaps, regexp_extract_all(text, '{literal}', 0) AS hits), null)"


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, digest, kind ("token" for tokens that only look like an identifier), start, end, hit, left, right.

    Distinct: rows with equal doc_id and text are one. Ends are exclusive, places are code points.
    """
    kinds = [_found(k, p, MAYBE[k]) for k, p in KINDS.items()] + [_found("token", TOKEN, "text rlike '[0-9@]'")]
    scanned = docs.select("doc_id", _digest().alias("digest"), "text").select("doc_id", "digest", F.explode(F.expr(f"array({', '.join(kinds)})")).alias("m"))
    # Each hit with the length and end of the gap before it and the start of the gap after it.
    parts = F.expr(f"""transform(m.hits, (h, i) -> struct(i AS at, length(m.gaps[i]) AS gap, right(m.gaps[i], {AROUND}) AS left, h AS hit, left(m.gaps[i + 1], {AROUND}) AS right))""")
    rows = scanned.filter("m is not null and size(m.hits) > 0").select("doc_id", "digest", F.col("m.kind").alias("kind"), F.inline(parts)).distinct()
    before = Window.partitionBy("doc_id", "digest", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.length("hit")).over(before).cast("long")
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))
    return placed.filter(_valid(F.col("kind"), F.col("hit"))).select("doc_id", "digest", "kind", "start", "end", "hit", "left", "right")


def _words(side: Column, take: str) -> Column:
    return F.lower(F.trim(F.regexp_extract(side, take, 0)))


def instances(found: DataFrame) -> DataFrame:
    """The matches outside others, with their lexical patterns: seeds have a kind, other tokens have none.

    A token that touches a base span of its document is part of it and no instance.
    """
    order = Window.partitionBy("doc_id", "digest").orderBy("start", "end")
    reach = F.max(F.when(F.col("kind") != "token", F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("kind") != "token", F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = found.withColumn("reach", reach).withColumn("ahead", ahead).filter((F.col("kind") != "token") | ((F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))))
    before, last, after = _words(F.col("left"), r"\S+\s+\S+\s*$"), _words(F.col("left"), r"\S+\s*$"), _words(F.col("right"), r"^\s*\S+")
    patterns = F.array_compact(F.array(F.when(before != "", F.concat(F.lit("L "), before)), F.when((last != "") & (after != ""), F.concat(F.lit("B "), last, F.lit(" _ "), after))))
    token = F.col("kind") == "token"
    seed = F.when(~token, F.col("kind")).when(_secret(F.col("hit")), ADDED[0])
    return free.select("doc_id", "digest", "start", "end", F.lower("hit").alias("value"), seed.alias("seed"), token.alias("is_token"), patterns.alias("patterns"))


def bootstrapped(places: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """doc_id, digest, kind, start, end of the tokens that confident patterns discover.

    The graph's edges are distinct (pattern, value) pairs, so a pattern or value counts once however often it is repeated. Known values only
    become more, so the rounds end.
    """
    edges = places.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("seed").alias("kind"))
    edges = materialise(edges, "pii-edges")
    known = materialise(edges.filter("kind is not null").groupBy("value").agg(F.max("kind").alias("known")), "pii-known")
    while True:
        marked = edges.select("pattern", "value").join(known, "value", "left")
        by_kind = marked.groupBy("pattern", "known").agg(F.count("*").alias("n"))
        own = by_kind.groupBy("pattern").agg(F.sum("n").alias("total"), F.max(F.when(F.col("known").isNotNull(), F.struct("n", "known"))).alias("top"))
        good = own.select("pattern", F.col("top.known").alias("kind"), F.col("top.n").alias("positive"), (F.col("top.n") / F.col("total")).alias("confidence"))
        scored = materialise(good.filter((F.col("positive") >= support) & (F.col("confidence") >= confidence)), "pii-patterns")
        # An instance is wrong only if all of its patterns are.
        doubt = edges.join(scored.withColumnRenamed("kind", "found"), "pattern").groupBy("value").agg(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))).alias("doubt"), F.max(F.struct("confidence", "found")).alias("best"))
        sure = doubt.filter(1 - F.exp("doubt") >= accept).select("value", F.col("best.found").alias("known"))
        fresh = materialise(sure.join(known, "value", "left_anti"), "pii-fresh")
        if fresh.isEmpty():
            break
        known = materialise(known.unionByName(fresh), "pii-known")
    kind = F.when(F.col("seed") == ADDED[0], ADDED[0]).otherwise(ADDED[1])
    open_ = places.filter("is_token").select("doc_id", "digest", "start", "end", "value", kind.alias("kind"), F.explode("patterns").alias("pattern"))
    hits = open_.join(scored.select("pattern"), "pattern", "left_semi").join(known.select("value"), "value", "left_semi")
    return hits.select("doc_id", "digest", "kind", "start", "end").distinct()


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (kind number from 0, start, end, kind), sorted.

    `spans` are the base ones and those that the method adds. Null and empty texts have none; texts are read whole; rows with equal
    doc_id and text get equal results; an empty table gives an empty result. Only doc_id and text are read.
    """
    found = materialise(matches(docs), "pii-matches")
    base = found.filter("kind <> 'token'").select("doc_id", "digest", "kind", "start", "end")
    added = bootstrapped(materialise(instances(found), "pii-instances"), **options)
    rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, *ADDED)]), F.col("kind")) - 1
    every = base.withColumn("is_base", F.lit(True)).unionByName(added.withColumn("is_base", F.lit(False)))
    span = F.struct(rank.alias("rank"), "start", "end", "kind")
    # The spans of a document meet in one row, as its text does.
    per_doc = every.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.when(F.col("is_base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "f_id", "digest": "f_digest"})
    rows = docs.select("doc_id", _digest().alias("digest"))
    out = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["f_id"]) & (rows["digest"] == per_doc["f_digest"]), "left")
    none = F.expr("array_remove(array(named_struct('rank', 0L, 'start', 0L, 'end', 0L, 'kind', '')), named_struct('rank', 0L, 'start', 0L, 'end', 0L, 'kind', ''))")
    return out.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_personal_data(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op8_personal_data": op8_personal_data}
#: Iterated scoring over possessive patterns cannot be expressed in DuckDB's SQL: tests compare with a plain search.
ORACLE = {}
