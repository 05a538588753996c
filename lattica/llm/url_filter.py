"""URL filter: allow and block rules, and for other URLs the ratio of two character models.

Two variable-order Markov models (contexts of up to three symbols, interpolated
by Witten and Bell's rule) are counted from URLs that rules allow and block. A
URL without a rule is judged by its log-likelihood difference over its length,
against a threshold calibrated on a fifth of the labelled URLs that the models
haven't seen. Symbols are 39 classes of characters, so the whole model has at
most 39 ** 4 rows whatever the corpus, which bounds the broadcast. DataFrame
functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = "/.:-_?=&#%"
#: The first symbol stands before the start; then letters, all digits as one, marks, and one for all else.
START, OTHER = "^", "~"
ALPHABET = START + LOWER + "0" + MARKS + OTHER
SYMBOLS = len(ALPHABET)
ORDER = 3


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    rule: str  # host and the start of the path, such as example.org/es/

    @property
    def parts(self) -> tuple[str, str]:
        host, slash, path = self.rule.partition("/")
        return host, slash + path


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def first_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):  # the last that fits wins
        h, p = r.parts
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def by_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, and the rule that fits with its verdict, both null where none does."""
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("f", first_rule(F.col("host"), F.col("path"), rules))
    return named.select("page_id", "url", "host", "path", F.col("f.rule").alias("rule"), F.col("f.verdict").alias("by_rule"))


def grams(url: Column) -> Column:
    """The URL's (ORDER + 1)-grams of symbols as texts over ALPHABET, one for each character; null for a null URL."""
    plain = F.translate(url, UPPER + "0123456789", LOWER + "0" * 10)
    symbols = F.regexp_replace(plain, rf"[^a-z0{re.escape(MARKS)}]", OTHER)
    # An empty match at every place that has ORDER more symbols after it, so one pass over the URL makes all.
    return F.regexp_extract_all(F.concat(F.lit(START * ORDER), symbols), F.lit(rf"(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def number(gram: Column) -> Column:
    """A gram's symbols as the digits of one number, the first of most weight."""
    digit = lambda k: (F.instr(F.lit(ALPHABET), F.substring(gram, k + 1, 1)) - 1).cast("long")
    return sum((digit(k) * SYMBOLS ** (ORDER - k) for k in range(1, ORDER + 1)), digit(0) * SYMBOLS**ORDER)


def model(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log P(symbol | context) under the accepted less under the rejected.

    counts: (gram, a, r), a row for every gram to be scored, with how often the
    models' URLs have it. At most SYMBOLS ** 4 rows.
    """
    lower = None
    for k in range(ORDER + 1):
        size = SYMBOLS ** (k + 1)
        here = counts.groupBy((F.col("gram") % size).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        of = Window.partitionBy("h")
        here = here.withColumn("h", F.floor(F.col("g") / SYMBOLS).cast("long"))
        for c in "ar":
            here = here.withColumn(f"n_{c}", F.sum(c).over(of)).withColumn(f"t_{c}", F.count(F.when(F.col(c) > 0, 1)).over(of))
        if lower is None:
            here = here.withColumns({f"p_{c}": F.lit(1.0 / SYMBOLS) for c in "ar"})
        else:
            here = here.withColumn("s", F.col("g") % (size // SYMBOLS)).join(lower, "s")
        p = lambda c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"p_{c}"))
        lower = here.select(F.col("g").alias("s"), p("a").alias("p_a"), p("r").alias("p_r"))
    return lower.select(F.col("s").alias("gram"), (F.log("p_a") - F.log("p_r")).alias("ratio"))


def threshold(labelled: DataFrame, step: float = 0.02, most: int = 500) -> float:
    """The score that parts allowed and blocked URLs best, by balanced accuracy; nearest 0 on ties, 0 without both kinds."""
    bin_ = F.least(F.greatest(F.round(F.col("score") / step), F.lit(-most)), F.lit(most)).cast("int")
    bins = labelled.groupBy(bin_.alias("bin")).agg(F.count(F.when(F.col("allowed"), 1)).alias("a"), F.count(F.when(~F.col("allowed"), 1)).alias("r"))  # 2 most + 1 rows
    up, all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    below = lambda c: F.try_divide(F.coalesce(F.sum(c).over(up), F.lit(0)), F.sum(c).over(all_))
    best = bins.select("bin", (below("r") - below("a")).alias("gain")).orderBy(F.desc_nulls_last("gain"), F.abs("bin"), "bin").first()
    return (best["bin"] - 0.5) * step if best and best["gain"] is not None else 0.0


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score for every row of pages.

    score: mean log-likelihood ratio of a URL's characters, 0 for a null or empty
    one. Without rules that allow and block some URL, all others are allowed that
    score 0 or more. Null ids and repeated rows are judged like any other; URLs of
    any length are read whole, and other columns are not read. Of rules of the same
    length the last in order of their text counts.
    """
    fold = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5))
    rows = by_rules(pages, rules).withColumn("fold", fold)
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))  # written, so that a row's number lasts
    kinds = rows.select(F.explode(grams(F.col("url"))).alias("text"), ((F.col("by_rule") == "allow") & (F.col("fold") != 0)).alias("a"), ((F.col("by_rule") == "block") & (F.col("fold") != 0)).alias("r"))
    counts = cut(kinds.groupBy("text").agg(F.count(F.when(F.col("a"), 1)).alias("a"), F.count(F.when(F.col("r"), 1)).alias("r")).withColumn("gram", number(F.col("text"))))
    ratios = cut(model(counts).join(counts.select("gram", "text"), "gram").select("text", "ratio"))
    parts = rows.select("rid", F.explode(grams(F.col("url"))).alias("text"))
    means = parts.join(F.broadcast(ratios), "text").groupBy("rid").agg(F.avg("ratio").alias("score"))  # at most SYMBOLS ** 4 rows are broadcast
    scored = cut(rows.join(means, "rid", "left").select("page_id", "host", "path", "rule", "by_rule", (F.col("fold") == 0).alias("held"), F.coalesce("score", F.lit(0.0)).alias("score")))
    limit = threshold(scored.filter("held AND by_rule IS NOT NULL").select("score", (F.col("by_rule") == "allow").alias("allowed")))
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def rules_query(spark, sf_dir: str) -> DataFrame:
    """Hosts, paths and rules alone, which SQL can express."""
    return by_rules(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


def _case(column: str) -> str:
    fits = []
    for r in sorted(RULES, key=lambda r: (-len(r.rule), r.rule)):
        h, p = r.parts
        fits.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{getattr(r, column)}'")
    return f"CASE {' '.join(fits)} END"


RULES_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
named AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, {_case('rule')} AS rule, {_case('verdict')} AS by_rule FROM named
"""
