"""URL filter: host and path rules, and a character language-model ratio for the rest.

URLs that a rule decides are the accepted and rejected examples; three sixteenths of them, by a digest, are held out
for calibration. Each class gets a variable-order Markov model of
characters of its other examples: the probability of a character after its context is the interpolation of all orders,

    p_n(c | h) = (count(h c) + strength * p_{n-1}(c | shorter h)) / (count(h) + strength),   p_{-1} = 1 / alphabet,

and a URL's score is the difference of its log-likelihoods divided by its length. The threshold is calibrated on the
held-out examples: between the mean scores of the two classes, at equal distance in standard deviations. Scores are integers
(millionths per character) so that sums do not depend on their order.

All of it is DataFrame expressions. Counts are combined per n-gram in the tasks before they are shuffled; the table of
n-gram scores is joined by key, and Spark broadcasts it only when its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import staged

#: (verdict, rule): fixed values of the registered query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]
ORDER = 4
STRENGTH = 4.0
ALPHABET = 96
#: Marks before the first character.
PAD = "\u0002"


def with_host_and_path(pages: DataFrame, url: Column) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", lower).withColumn("path", path)


def with_rule(frame: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and ruled (its verdict): the longest that fits, of equally long ones the first listed."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, ruled = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return frame.withColumn("rule", rule).withColumn("ruled", ruled)


def grams(urls: DataFrame, order: int) -> DataFrame:
    """One row per character: key, ruled (null if held out), gram (the character after ``order`` others, padded at the start)."""
    text = F.concat(F.lit(PAD * order), F.col("url"))
    return urls.filter("length(url) > 0").withColumn("padded", text).select(
        "key", F.when(~F.col("held"), F.col("ruled")).alias("ruled"), F.explode(F.expr(f"transform(sequence(1, length(url)), i -> substring(padded, i, {order + 1}))"))
        .alias("gram"))


def gram_scores(chars: DataFrame, order: int, strength: float) -> DataFrame:
    """(gram, llr): the log-likelihood ratio of every n-gram that occurs, in millionths."""
    seen = chars.groupBy("gram").agg(*[F.sum((F.col("ruled") == v).cast("long")).alias(v) for v in ("allow", "block")])
    level = seen.select("gram", *[F.coalesce(v, F.lit(0)).alias(v) for v in ("allow", "block")])
    levels = [staged(level, "grams")]
    for n in range(order, 0, -1):  # counts of the suffixes of length n
        levels.append(levels[-1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(
            F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    levels.reverse()
    lower = None
    for n, level in enumerate(levels):
        context = level.groupBy(F.expr(f"substring(gram, 1, {n})").alias("context")).agg(
            F.sum("allow").alias("allow_all"), F.sum("block").alias("block_all"))
        joined = level.withColumn("context", F.expr(f"substring(gram, 1, {n})")).join(context, "context")
        if lower is None:
            joined = joined.withColumn("allow_p", F.lit(1 / ALPHABET)).withColumn("block_p", F.lit(1 / ALPHABET))
        else:
            joined = joined.withColumn("shorter", F.expr(f"substring(gram, 2, {n})")).join(
                lower.select(F.col("gram").alias("shorter"), "allow_p", "block_p"), "shorter")
        lower = joined.select("gram", "allow", "block", *[
            ((F.col(v) + strength * F.col(f"{v}_p")) / (F.col(f"{v}_all") + strength)).alias(f"{v}_p")
            for v in ("allow", "block")])
    return lower.select("gram", F.round(F.log(F.col("allow_p") / F.col("block_p")) * 1_000_000).cast("long").alias("llr"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
               order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (millionths per character, null for an empty url).

    A rule's verdict stands; other URLs are allowed when their score reaches the calibrated threshold. Without held-out
    examples of both classes the threshold is 0. A null or empty url has no host, path, rule or score and is blocked. Equal
    urls are scored once and share the result; null ids stay null, repeated rows get a row each, other columns are
    ignored, an empty table gives an empty result.
    """
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    ruled = with_rule(with_host_and_path(source, F.col("url")), rules)
    urls = staged(ruled.filter("url is not null").groupBy("url").agg(F.first("ruled").alias("ruled"),
                                                                     F.count(F.lit(1)).alias("n"))
                  .withColumn("key", F.sha2("url", 256))
                  .withColumn("held", F.substring("key", 1, 1).isin("0", "1", "2")), "urls")
    chars = grams(urls, order)
    scores = gram_scores(chars, order, strength)
    sums = chars.join(scores, "gram").groupBy("key").agg(F.sum("llr").alias("llr"), F.count(F.lit(1)).alias("chars"))
    scored = staged(urls.join(sums, "key").select(
        "url", "ruled", "held", F.floor(F.col("llr") / F.col("chars")).cast("long").alias("score")), "scores")
    stats = scored.filter("held").agg(*[f(F.when(F.col("ruled") == v, F.col("score"))).alias(f"{name}_{v}")
                         for v in ("allow", "block") for name, f in (("mean", F.avg), ("dev", F.stddev_pop))])
    even = ((F.col("mean_allow") * F.col("dev_block") + F.col("mean_block") * F.col("dev_allow"))
            / F.nullif(F.col("dev_allow") + F.col("dev_block"), F.lit(0.0)))
    limit = F.floor(F.coalesce(even, (F.col("mean_allow") + F.col("mean_block")) / 2, F.lit(0.0))).cast("long")
    threshold = stats.select(limit.alias("limit")).first()["limit"]
    own = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block")
    return ruled.join(scored.select("url", "score"), "url", "left").select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("ruled", own).alias("verdict"), "score")
