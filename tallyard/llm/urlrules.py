"""URL filtering by association rules, in DataFrame operations only.

A URL becomes a set of tokens: labels and suffixes of its host, segments of its path with
numbers levelled, file ending, names of its parameters, scheme. Pages are labelled by the
document that their url numbers, if it is labelled; a quarter of the labelled urls is held
out. Spark's FP-growth mines combinations of tokens with the labels of the others; rules that
conclude "block" and pass support, confidence and lift are kept, pruned when a shorter rule
they contain is as confident, and dropped unless confidence and lift hold on the pages held
out. So labels that don't depend on urls give no rule. Matching is by inverted index: a rule
is listed under its rarest token, a token set meets it there by equality, and it matches when
all its tokens are in the set. Tokens of the same labelled pages are one to rules and sets.
Different token sets are matched once, not once for each page.

Fixed rules (host and path) come first and teach nothing, as they decide their pages anyway;
the mined rules judge what those leave.

Defined results: a null url or one without ``://`` has empty host and path and is allowed;
without labelled pages nothing is mined and everything left is allowed; repeated rows are
judged each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.llm.common import lookup_join, materialise, maybe_broadcast

# fixed values: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
SUPPORT, CONFIDENCE, LIFT = 0.002, 0.6, 1.5
#: Labelled pages that a rule must cover, whatever their number, and of pages held out; of labelled urls, one in so many is held out.
LEAST_PAGES, LEAST_HELD, HELD_OUT = 20, 5, 4
BLOCKED = "=block"

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda x: len(x[1]) + len(x[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL, sorted."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    names = F.transform(labels, lambda x: F.concat(F.lit("h:"), x))
    endings = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda n: F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")),
    )
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    level = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "9")
    parts = F.transform(segments, lambda x: F.concat(F.lit("p:"), level(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    scheme = F.concat(F.lit("s:"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z]+)://", 1)))
    known = F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(names, endings, parts, keys, F.array(scheme)))
    return F.array_sort(F.array_distinct(known))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens, ``bad`` and ``held`` (whether it is held out) of the pages whose url ends in the number of a labelled document.

    A document marked as toxic or of low quality speaks for blocking.
    """
    bad = F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("number")).agg(bad.alias("bad"))
    url = F.col("url").cast("string")
    number = F.regexp_extract(path_of(url), r"([0-9]+)[^0-9/]*/?$", 1).try_cast("long")
    held = F.pmod(F.xxhash64(url), F.lit(HELD_OUT)) == 0
    return pages.select(tokens_of(url).alias("tokens"), number.alias("number"), held.alias("held")).join(known, "number").select("tokens", "bad", "held")


def mine(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule, confidence, support, lift of the rules kept; token, member of the tokens that stand for others).

    ``marked`` has tokens and ``bad``. Tokens of the same pages (a deep common path has many) are
    mined as one, the first of them: a rule with two would fall to the one without, and
    combinations would double with each token.
    """
    spark = marked.sparkSession
    marked = materialise(marked, "marked")
    total = marked.count()
    if not total:
        none = spark.createDataFrame([], "rule array<string>, confidence double, lift double, support double")
        return none, spark.createDataFrame([], "token string, member string")
    support = min(1.0, max(SUPPORT, LEAST_PAGES / total))
    page = [F.xxhash64("tokens", F.lit(i)).cast("decimal(38,0)") for i in (1, 2)]
    seen = marked.select(F.explode("tokens").alias("token"), page[0].alias("x"), page[1].alias("y"))
    seen = seen.groupBy("token").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).filter(F.col("n") >= F.lit(support * total * 0.999))
    alike = seen.groupBy("n", "x", "y").agg(F.min("token").alias("token"), F.collect_list("token").alias("members"))
    alike = materialise(alike.select("token", "n", F.explode("members").alias("member")), "alike")
    frequent = alike.filter("token = member")
    numbered = materialise(marked.select(F.expr("uuid()").alias("page"), "tokens", "bad"), "numbered")
    first = numbered.select("page", F.explode("tokens").alias("token")).join(frequent, "token", "left_semi").groupBy("page").agg(F.collect_list("token").alias("few"))
    few = numbered.join(first, "page", "left").select(F.coalesce("few", F.array().cast("array<string>")).alias("tokens"), "bad")
    baskets = few.select(F.when(F.col("bad") == 1, F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens")).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=CONFIDENCE, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(baskets).associationRules
    kept = rules.filter(F.array_contains("consequent", BLOCKED) & (F.col("lift") >= LIFT))
    kept = materialise(kept.select(F.array_sort("antecedent").alias("rule"), "confidence", "lift", "support"), "rules")
    # a rule falls if a shorter one within it is as confident; they meet at the shorter one's rarest token
    listed = materialise(_listed(kept, frequent.select("token", "n")), "listed")
    short = listed.select(F.col("rule").alias("inner"), F.col("confidence").alias("inner_confidence"), F.col("rarest").alias("token"))
    worse = (
        listed.select("rule", "confidence", F.explode("rule").alias("token")).join(short, "token")
        .filter((F.size("inner") < F.size("rule")) & (F.col("inner_confidence") >= F.col("confidence")) & (F.size(F.array_except("inner", "rule")) == 0))
        .select("rule").distinct()
    )
    return materialise(kept.join(worse, "rule", "left_anti"), "pruned"), alike.select("token", "member")


def represented(sets: DataFrame, alike: DataFrame) -> DataFrame:
    """key, tokens of the token sets, with tokens that others stand for replaced by those."""
    flat = sets.select("key", F.explode("tokens").alias("member"))
    own = flat.join(maybe_broadcast(alike), "member", "left").select("key", F.coalesce("token", "member").alias("token"))
    return own.groupBy("key").agg(F.collect_set("token").alias("tokens"))


def hold(rules: DataFrame, alike: DataFrame, marked: DataFrame) -> DataFrame:
    """The ``rules`` whose confidence and lift hold on the pages of ``marked`` (tokens, bad) too, with ``held_confidence``."""
    whole = marked.groupBy("tokens").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).withColumn("key", F.xxhash64("tokens"))
    whole = materialise(whole, "held-out")
    share = whole.agg(F.sum("bad") / F.sum("n")).first()[0]
    if not share:
        return rules.withColumn("held_confidence", F.lit(0.0)).limit(0)
    met = hits(represented(whole, alike), rules).join(whole.select("key", "n", "bad"), "key")
    told = met.groupBy("rule").agg(F.sum("n").alias("pages"), (F.sum("bad") / F.sum("n")).alias("held_confidence"))
    told = told.filter((F.col("pages") >= LEAST_HELD) & (F.col("held_confidence") >= CONFIDENCE) & (F.col("held_confidence") >= LIFT * share))
    return rules.join(told.select("rule", "held_confidence"), "rule")


def _listed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rules`` with ``rarest``, the token of each that ``tokens`` (token, n) counts the fewest of."""
    counted = rules.select("rule", F.explode("rule").alias("token")).join(tokens, "token", "left")
    rarest = counted.groupBy("rule").agg(F.min(F.struct("n", "token")).alias("least")).select("rule", F.col("least.token").alias("rarest"))
    return rules.join(rarest, "rule")


def hits(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """key, rule, confidence of every rule that is whole in one of the token sets (key, tokens)."""
    met = token_sets.select("key", "tokens", F.explode("tokens").alias("token"))
    counts = met.join(maybe_broadcast(rules.select(F.explode("rule").alias("token")).distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = materialise(_listed(rules.select("rule", "confidence"), counts), "index").withColumnRenamed("rarest", "token")
    return met.join(maybe_broadcast(index), "token").filter(F.size(F.array_except("rule", "tokens")) == 0).select("key", "rule", "confidence")


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """key, rule of the token sets (key, tokens) that hold a whole rule; the most confident of each."""
    best = F.max(F.struct("confidence", (-F.size("rule")).alias("size"), F.array_join("rule", " ").alias("name")))
    return hits(token_sets, rules).groupBy("key").agg(best.alias("best")).select("key", F.col("best.name").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def learn(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules mined of three quarters of the labelled urls that hold on the rest, and the tokens that stand for others."""
    marked = materialise(labelled(pages, labels), "labelled")
    rules, alike = mine(marked.filter("not held").select("tokens", "bad"))
    if rules.isEmpty():
        return rules, alike
    return materialise(hold(rules, alike, marked.filter("held")), "held"), alike


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of each page, and the mined rule that blocks it."""
    rules, alike = learn(pages, labels)
    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    tokens = tokens_of(url)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.xxhash64(tokens).alias("key"), tokens.alias("tokens"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("fixed", verdict)
    if rules.isEmpty():
        hit = rows.withColumn("mined_rule", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    else:
        rows = materialise(rows, "urls")
        sets = rows.filter("rule is null").groupBy("key").agg(F.first("tokens").alias("tokens"))
        found = materialise(matched(represented(sets, alike), rules), "matched")
        few = found.limit(20_001).count() <= 20_000
        hit = rows.join(F.broadcast(found), "key", "left") if few else lookup_join(rows, found, "key", ["page_id"], "left")
    blocked = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return hit.select(
        "page_id", "host", "path", "rule", F.coalesce("fixed", blocked).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("mined_rule")).alias("mined_rule"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"),
    )
