"""URL filters: given host and path rules first, then rules mined from labelled URLs.

Labelled URLs become sets of tokens; Spark's FP-growth finds the combinations that occur often, and
those that point to a block label with enough confidence become rules. A rule is posted in an
inverted index under its rarest token only, so that tokens which most URLs share post nothing.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import ascii_lower, stored

#: The class of a blocked URL: no token has this prefix.
BLOCKED = "class:block"
#: Most mined rules that are sent whole to every executor.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def given_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none fits.

    ``rules``: ``host/path`` to ``allow`` or ``block``. A handful, so they become one expression.
    """
    fits, verdicts = [], []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        hit = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        fits.append(F.when(hit, F.lit(rule)))
        verdicts.append(F.when(hit, F.lit(rules[rule])))
    nothing = F.lit(None).cast("string")
    return F.coalesce(*fits, nothing), F.coalesce(*verdicts, nothing)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, host and its labels, folders (numbers alike), extension, query keys, fragment."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = lambda prefix, values: F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(prefix), v))
    folders = F.transform(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "/"), lambda v: F.when(v.rlike(r"^\d+$"), F.lit("#")).otherwise(v))
    everything = F.concat(
        parts("scheme:", F.array(ascii_lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
        parts("host:", F.array(host)), parts("label:", F.split(host, r"\.")), parts("dir:", folders),
        parts("ext:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))),
        parts("key:", F.transform(F.split(query, "&"), lambda v: F.regexp_extract(v, r"^([^=]*)", 1))),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(everything))


def mine_rules(labelled: DataFrame, *, min_support: float = 0.002, min_rows: int = 5, min_confidence: float = 0.6, min_lift: float = 1.0) -> DataFrame:
    """rule_id, tokens, confidence, support: combinations whose URLs are mostly blocked.

    ``labelled``: url, blocked. A rule's tokens must be in ``min_support`` of the labelled rows and in
    ``min_rows``; so at most (tokens a URL / min_support) tokens are frequent, however many rows there
    are. A rule that holds another of no less confidence is dropped, as is one below ``min_lift``,
    its confidence by the share of blocked rows (1: no rule that is worse than chance). Rows with a
    null URL or label teach nothing; repeated rows count as often as they occur. No labelled rows: no
    rules.

    Tokens that are in the same labelled rows (a host and its labels, all folders of one template) are one
    item while patterns grow, so a URL's depth does not multiply them; a rule is then told with each of
    the tokens that stand for its items. Folders that are nested in ever fewer rows stay items of their own.
    """
    spark = labelled.sparkSession
    known = labelled.filter(F.col("url").isNotNull() & F.col("blocked").isNotNull())
    rows = stored(known.select(F.monotonically_increasing_id().alias("row"), tokens_of(F.col("url")).alias("tokens"), "blocked"))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    least = min(1.0, max(min_support, min_rows / n))
    # which rows a token is in, as a count and two sums of hashes
    told = [F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    frequent = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *told).filter(F.col("n") >= F.lit(least * n - 1e-9))
    alike = stored(frequent.groupBy("n", "h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.col("members")[0].alias("item"), "members"))
    items = rows.select("row", F.explode("tokens").alias("token")).join(alike.select(F.explode("members").alias("token"), "item"), "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    bad = F.when(F.col("blocked"), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))
    baskets = stored(rows.join(items, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), bad).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    rules = (
        model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCKED) & (F.col("lift") >= min_lift))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
        .withColumn("rule_id", F.xxhash64("tokens"))
    )
    rules = stored(rules)
    # a more general rule with the same confidence or more makes the longer one needless
    shorter = rules.select(F.explode("tokens").alias("token"), F.col("rule_id").alias("less_id"), F.col("tokens").alias("less"), F.col("confidence").alias("less_confidence"))
    needless = (
        rules.withColumn("token", F.explode("tokens")).join(shorter, "token")
        .filter((F.size("less") < F.size("tokens")) & (F.col("less_confidence") >= F.col("confidence")) & (F.size(F.array_except("less", "tokens")) == 0))
        .select("rule_id").distinct()
    )
    kept = rules.join(needless, "rule_id", "left_anti")
    # each item by any of the tokens that stand for it
    choices = kept.select("rule_id", F.explode("tokens").alias("item")).join(alike, "item").groupBy("rule_id").agg(F.collect_list("members").alias("choices"))
    said = F.aggregate("choices", F.array(F.array().cast("array<string>")), lambda done, some: F.flatten(F.transform(done, lambda one: F.transform(some, lambda token: F.concat(one, F.array(token))))))
    each = kept.join(choices, "rule_id").select(F.explode(said).alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens"))
    return each.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "support")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, confidence for the distinct URLs that a mined rule matches: the surest one, then the widest, then by name."""
    urls = urls.filter("url is not null").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    rules = stored(rules)
    posted = urls.select(F.explode("tokens").alias("token"))
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    small = rules.count() <= BROADCAST_RULES
    near = F.broadcast if small else (lambda df: df)
    frequency = posted.join(near(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = (
        rules.withColumn("token", F.explode("tokens")).join(frequency, "token", "left")
        .groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rare"), F.first("tokens").alias("rule_tokens"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
        .select(F.col("rare.token").alias("token"), "rule_tokens", "confidence", "support")
    )
    hits = urls.withColumn("token", F.explode("tokens")).join(near(stored(index)), "token").filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = hits.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.concat_ws(" ", "rule_tokens").alias("rule"))).alias("best"))
    return best.select("url", F.col("best.rule").alias("mined_rule"), (-F.col("best.c")).alias("mined_confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: dict[str, str], *, id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, mined_confidence for every page.

    A given rule decides; else ``block`` where a mined rule matches, ``allow`` where none does. A null
    URL has empty host and path, no rule, and is allowed. Repeated rows each get a row; other columns
    of ``pages`` are ignored.
    """
    mined = match_rules(pages.select(F.col(url_col).alias("url")), mine_rules(labelled, **mining))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    # rows without a URL match nothing: each gets a key of its own, so that they don't meet in one task
    rows = rows.withColumn("at", F.coalesce("url", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))))
    rows = rows.join(mined.withColumnRenamed("url", "at"), "at", "left")
    host, path = host_of(F.coalesce("url", F.lit(""))), path_of(F.coalesce("url", F.lit("")))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "mined_rule", "mined_confidence")
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    other = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"), "mined_rule", "mined_confidence")
