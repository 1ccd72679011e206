"""URL filter: a list of rules by host and path, and rules over URL tokens mined by FP-growth from labelled URLs.

List rules decide first: a rule fits its host and all hosts below it where the path starts with the rule's path; the longest
rule (host and path together) wins, the longer host among equally long ones, then the first in order of text.

The other URLs are judged by association rules. A URL's tokens are its host's suffixes (``h:example.org``), the words of its path
(``p:en``) and the names of its parameters (``q:page``). Over a sample of labelled URLs, each with its label as one more item, Spark's FP-growth
finds the frequent combinations; a combination that stands with one label in at least ``CONFIDENCE`` of its URLs, and in
``SUPPORT`` URLs or more, is a rule. Rules that a rule with fewer tokens, the same label and at least the same confidence covers are pruned.

To match, rules are indexed by their rarest token. The tokens of each URL are looked up in that index, and the rules
found are opened: all their tokens must be in the URL. The surest rule decides (then the better supported, then block before allow);
URLs without any are allowed. Matching needs one shuffle, after the best rule of each row has been chosen in its task.

Bounds: the sample has some SAMPLE rows, drawn by hash, and rows of more than TRAIN_TOKENS tokens are not taken into it, as their combinations
are exponential. Rules with at most SENT_RULES rows are broadcast; more join by token, with hot tokens sent alone.

Edge cases: a null URL and one without ``://`` have an empty host and path, fit no rule and have no token: allowed. Repeated rows and
ids and null ids are judged row by row; without labels nothing is mined; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written

#: Labelled rows to mine from, and the most tokens of such a row.
SAMPLE, TRAIN_TOKENS = 200_000, 20
#: Least number and share of a combination's URLs with the label.
SUPPORT, CONFIDENCE = 20, 0.6
#: Rules that are broadcast: some 100 bytes each.
SENT_RULES = 50_000

#: (verdict, host, path), fixed values of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICT = "=verdict:"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query of a URL; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The list rule that decides, as struct (rule, verdict); null if none fits."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:], r[0]))
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in reversed(order):
        fits = (host != "") & ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens of a URL."""
    names = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(names, k, F.size(names)), ".")))
    words = F.transform(F.filter(F.split(F.translate(path, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("p:"), w))
    params = F.transform(F.filter(F.transform(F.split(F.translate(query, UPPER, LOWER), "[&;]"), lambda x: F.substring_index(x, "=", 1)), lambda w: w != ""), lambda w: F.concat(F.lit("q:"), w))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, words, params)))


def mine(labelled: DataFrame, sample: int = SAMPLE, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (id, antecedent, verdict, n, confidence, token) from labelled rows (url, verdict); ``token`` is the rarest of each."""
    spark = labelled.sparkSession
    host, path, query = parts(F.col("url"))
    rows = labelled.where(F.col("url").isNotNull() & F.col("verdict").isin("allow", "block")).select(F.concat(tokens(host, path, query), F.array(F.concat(F.lit(VERDICT), F.col("verdict")))).alias("items"), F.xxhash64("url").alias("draw"))
    rows = rows.where(F.size("items").between(2, TRAIN_TOKENS + 1))
    total = rows.count()
    share = min(1.0, sample / max(total, 1))
    drawn = written(rows.where(F.col("draw").cast("double") < (2.0 * share - 1.0) * 2.0**63 if share < 1 else F.lit(True)).select("items"), "url-sample")
    n = drawn.count()
    schema = "id long, antecedent array<string>, verdict string, n long, confidence double, token string"
    if n < support:
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=support / n, minConfidence=confidence).fit(drawn)
    sets = written(model.freqItemsets, "url-itemsets")
    label = F.filter("items", lambda t: t.startswith(VERDICT))
    named = sets.select("items", F.col("freq").alias("n"), F.get(label, 0).alias("label"), F.array_sort(F.filter("items", lambda t: ~t.startswith(VERDICT))).alias("antecedent"))
    both = named.where(F.col("label").isNotNull() & (F.size("antecedent") > 0)).select("antecedent", F.substring("label", len(VERDICT) + 1, 16).alias("verdict"), "n")
    whole = named.where(F.col("label").isNull()).select("antecedent", F.col("n").alias("of"))
    rules = written(both.join(whole, "antecedent").withColumn("confidence", F.col("n") / F.col("of")).where(F.col("confidence") >= confidence).withColumn("id", F.xxhash64("antecedent", "verdict")), "url-rules")
    # pruned: one token less gives a rule at least as sure; longer chains lose their last link first
    less = rules.select("id", "verdict", "confidence", F.explode(F.transform(F.col("antecedent"), lambda t: F.array_except("antecedent", F.array(t)))).alias("shorter"))
    known = rules.select(F.col("antecedent").alias("shorter"), "verdict", F.col("confidence").alias("sure"))
    covered = less.join(known, ["shorter", "verdict"]).where("sure >= confidence").select("id").distinct()
    kept = rules.join(covered, "id", "left_anti")
    rare = sets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), F.col("freq").alias("seen"))
    by_token = kept.select("*", F.explode("antecedent").alias("token")).join(rare, "token")
    index = by_token.groupBy("id").agg(F.first("antecedent").alias("antecedent"), F.first("verdict").alias("verdict"), F.first("n").alias("n"), F.first("confidence").alias("confidence"), F.min_by("token", F.struct("seen", "token")).alias("token"))
    return written(index, "url-index")


def judge(pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", sent: int = SENT_RULES) -> DataFrame:
    """(id, host, path, rule, verdict, n_rules) of each row; ``n_rules`` is how many mined rules fit a row the list leaves open."""
    host, path, query = parts(F.col("url"))
    read = pages.select(F.col(id_col), "url").select(id_col, host.alias("host"), path.alias("path"), query.alias("query"))
    told = read.select(id_col, "host", "path", F.col("query"), listed(F.col("host"), F.col("path"), rules).alias("listed"))
    rows = told.select(F.monotonically_increasing_id().alias("row"), id_col, "host", "path", "listed", F.when(F.col("listed").isNull(), tokens(F.col("host"), F.col("path"), F.col("query"))).otherwise(F.array().cast("array<string>")).alias("tokens"))
    many = mined.count()
    index = mined.groupBy("token").agg(F.collect_list(F.struct("antecedent", "verdict", "n", "confidence")).alias("opened"))
    plain = [id_col, "host", "path", "listed"]
    if many <= sent:
        each = rows.select("row", *plain, "tokens", F.explode_outer("tokens").alias("token")).join(F.broadcast(index), "token", "left")
    else:
        table = written(rows, "urls")
        looked = written(table.select("row", "tokens", F.explode("tokens").alias("token")), "url-tokens")
        sizes = looked.groupBy("token").agg(F.count("*").alias("rows"))
        found = join_groups(looked, written(index.join(sizes, "token"), "url-opened"), "token", "rows")
        each = table.select("row", *plain, F.array().cast("array<string>").alias("tokens"), F.lit(None).cast("string").alias("token"), F.lit(None).cast(index.schema["opened"].dataType).alias("opened"))
        each = each.unionByName(found.select("row", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in plain], "tokens", "token", "opened"))
    fit = F.filter("opened", lambda r: F.size(F.array_except(r["antecedent"], F.col("tokens"))) == 0)
    ranked = F.transform(fit, lambda r: F.struct(r["confidence"].alias("confidence"), r["n"].alias("n"), r["verdict"].alias("verdict")))
    each = each.select("row", *plain, F.array_max(ranked).alias("best"), F.coalesce(F.size(ranked), F.lit(0)).alias("fits"))
    best = each.groupBy("row").agg(*[F.first(c, ignorenulls=True).alias(c) for c in plain], F.max("best").alias("best"), F.sum(F.greatest("fits", F.lit(0))).alias("n_rules"))
    return best.select(id_col, "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", "best.verdict", F.lit("allow")).alias("verdict"), "n_rules")
