"""URL filter: rules indexed by their rarest literal token [DataFrame functions only].

A rule is a regular expression over ``host || path`` plus the literal tokens that
every URL it matches must contain.  Each rule is filed under that token of its own
which the fewest URLs of the corpus contain; a URL's tokens fetch the rules filed
under them, and only those run their regular expression.  Rules without a literal
are filed under the empty token, which every URL has, so none is lost.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Tokens: runs of ASCII letters and digits and of anything beyond ASCII.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_TOKEN_PY = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
#: Rules up to this many are joined by broadcast (about 200 bytes each).
BROADCAST_RULES = 20_000

# The list rules (verdict, host, path) of the contract.
LIST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
              ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Pattern rules that decide where no list rule fits: (pattern, literals).
PATTERN_RULES = [
    (r"(?:^|[.\-])cheap-pills(?:[.\-]|/|$)", ["cheap", "pills"]),
    (r"(?:^|[.\-])(?:online-)?casino(?:[.\-]|/|$)", ["casino"]),
    (r"(?:^|[.\-])poker(?:[.\-]|/|$)", ["poker"]),
    (r"(?:^|[.\-])payday-loans?(?:[.\-]|/|$)", ["payday"]),
    (r"(?:^|[.\-])viagra(?:[.\-]|/|$)", ["viagra"]),
    (r"(?:^|[.\-])porn(?:[.\-]|/|$)", ["porn"]),
    (r"/wp-login\.php$", ["wp", "login", "php"]),
]


@dataclass(frozen=True)
class Rule:
    """``name`` is null for pattern rules; ``span`` is the length a list rule wins by."""

    name: str | None
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    span: int


def list_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path`` (``/...``)."""
    literals = _TOKEN_PY.findall(host)
    # The last path token is whole only if something ends it inside the rule.
    inner = path[:max(0, len(path) - len(re.search("[0-9A-Za-z\u0080-\U0010ffff]*$", path)[0]))]
    literals += _TOKEN_PY.findall(inner)
    pattern = rf"^(?:[^/?#]*\.)?\Q{host}{path}\E"
    return Rule(host + path, verdict, pattern, tuple(x.translate(_FOLD) for x in literals), len(host + path))


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def production_rules() -> list[Rule]:
    return [list_rule(*r) for r in LIST_RULES] + [
        Rule(None, "block", p, tuple(lit), 0) for p, lit in PATTERN_RULES]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.name, r.verdict, r.pattern, list(r.literals), r.span) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "rule_no int, name string, verdict string, pattern string, literals array<string>, span int")


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    Null URL or none with ``://``: empty host and path, verdict of the rules that
    match the empty string (none here), so ``allow``.  Repeated rows are judged
    alike; an empty table gives an empty result.  Only the id and URL columns are
    read, other columns may have any name.  Ties in length: block before allow,
    then the rule's text.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = rules_frame(spark, production_rules())
    p = pages.select(F.col(id_col).alias(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    # The work depends on the URL alone: once per distinct URL, however often it occurs.
    urls = p.select("url").distinct().select("url", host_of(F.col("url")).alias("host"),
                                             path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("target", F.concat("host", "path")).withColumn(
        "token", F.explode(F.concat(F.array(F.lit("")), F.array_distinct(
            F.regexp_extract_all(ascii_lower(F.col("target")), F.lit(TOKEN), F.lit(0))))))
    counts = urls.groupBy("token").agg(F.count(F.lit(1)).alias("n_urls"))
    literals = rules.select("rule_no", F.explode_outer("literals").alias("token")).na.fill("", ["token"])
    # Rarest literal of each rule by corpus counts; a literal in no URL counts 0.
    filed = (literals.join(counts, "token", "left").groupBy("rule_no")
             .agg(F.min(F.struct(F.coalesce("n_urls", F.lit(0)), "token"))["token"].alias("token")))
    index = filed.join(rules.drop("literals"), "rule_no").drop("rule_no")
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    hits = urls.join(index, "token").where(F.expr("target rlike pattern"))
    best = hits.groupBy("url").agg(
        F.max(F.when(F.col("name").isNotNull(), F.struct(
            F.col("span"), (F.col("verdict") == "block").alias("b"), F.col("name")))).alias("listed"),
        F.max((F.col("name").isNull() & (F.col("verdict") == "block")).cast("int")).alias("pattern_block"))
    j = p.join(best, "url", "left")
    verdict = (F.when(F.col("listed").isNotNull(), F.when(F.col("listed.b"), "block").otherwise("allow"))
               .when(F.col("pattern_block") == 1, "block").otherwise("allow"))
    return j.select(F.col(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                    F.col("listed.name").alias("rule"), verdict.alias("verdict"))
