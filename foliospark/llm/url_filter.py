"""URL filters: host and path rules, and pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression with the literal tokens (runs of a-z, 0-9 and _) that any match must hold. Token
counts over the distinct URLs pick each rule's rarest token; URL tokens then fetch candidate rules by a join on the
token, and only candidates run their expression. All of it is DataFrame work. Host and path rules come first: the
longest that fits decides. Then a blocking pattern, then an allowing one; a URL that nothing matches is allowed.

Verdicts depend on the URL alone, so the patterns judge each distinct URL once. The verdicts go back to the rows by a
join, but not to rows without URL; those of the URLs that a 2000th of all rows have, or more, and there are at most 2000
of these, are broadcast, so no task gets all rows of a hot URL.

Defined cases: null URLs and URLs without :// have empty host and path; they can match no host rule, and only non-null
ones can match patterns; URLs of any length are judged whole; of host rules equally long the last in order decides, of
patterns the first; repeated rows are judged alike; other columns pass through, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import HOT, LEAST, Written

#: (verdict, host, path)
HOST_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("allow", "net", "/de/"), ("block", "org", "/es/")]
#: (name, verdict, expression on the lower-cased URL, literal tokens that any match holds)
PATTERN_RULES = [
    ("tracked-copy", "block", r"[?&]utm_source=[a-z0-9]", ["utm_source"]),
    ("referred-page", "block", r"[?&]page=[0-9]+&ref=", ["page", "ref"]),
    ("login", "block", r"/(wp-)?login(\.php|/|$)", ["login"]),
    ("cart", "block", r"/cart(/|\?|$)", ["cart"]),
    ("casino", "block", r"://([a-z0-9-]+\.)*casino[.-]", ["casino"]),
    ("session", "block", r"[?;&]phpsessid=", ["phpsessid"]),
    ("docs", "allow", r"/docs/[a-z]", ["docs"]),
]
_HOST, _REST = "^.*?://([^/?#]*)", "^.*?://[^/?#]*([^?#]*)"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: str = "url") -> Column:
    return F.coalesce(_lower(F.regexp_extract(F.col(url), "(?s)" + _HOST, 1)), F.lit(""))


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), "(?s)" + _REST, 1), F.lit(""))


def by_host_rules(what, rules=HOST_RULES) -> Column:
    """what(rule) of the longest rule that fits `host` and `path`, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == rule[1]) | F.col("host").endswith("." + rule[1])) & F.col("path").startswith(rule[2])
        out = F.when(fits, F.lit(what(rule))).otherwise(out)
    return out


def counted_urls(urls: DataFrame) -> DataFrame:
    """(url, low, n): the distinct URLs, in lower case too, and how many rows have each."""
    return urls.filter("url is not null").groupBy("url").agg(F.count("*").alias("n")).select("url", _lower(F.col("url")).alias("low"), "n")


def pattern_verdicts(distinct: DataFrame, rules=PATTERN_RULES) -> DataFrame:
    """(url, pattern, pattern_verdict) for the URLs of a written table of counted_urls() that a pattern rule matches."""
    spark = distinct.sparkSession
    tokens = distinct.select("url", "low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9_]+"), 0))).alias("token"))
    for name, verdict, expression, literals in rules:
        if verdict not in ("allow", "block") or not literals or any(not re.fullmatch("[a-z0-9_]+", t) for t in literals):
            raise ValueError(f"rule {name} needs a verdict and literal tokens")
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "number int, pattern string, pattern_verdict string, expression string, literals array<string>")
    asked = table.select("number", F.explode("literals").alias("token"))
    counts = tokens.join(asked.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "token", "left").groupBy("number").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("r")).select("number", "r.token")
    index = rarest.join(table.drop("literals"), "number")
    matched = tokens.join(index, "token").filter(F.expr("low rlike expression"))
    first = F.min(F.struct(F.when(F.col("pattern_verdict") == "block", 0).otherwise(1).alias("o"), "number", "pattern", "pattern_verdict"))
    return matched.groupBy("url").agg(first.alias("m")).select("url", "m.pattern", "m.pattern_verdict")


def judge(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """`pages` (with `url`) plus host, path, rule, pattern and verdict, which replace input columns of the same name."""
    added = ["host", "path", "rule", "pattern", "verdict"]
    own = [c for c in pages.columns if c not in added]
    # The other columns in one, so that their names clash with none made here.
    parts = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), "url", host().alias("host"), path().alias("path"))
    ruled = parts.withColumns({"rule": by_host_rules(lambda r: r[1] + r[2], host_rules), "ruled": by_host_rules(lambda r: r[0], host_rules)})
    distinct = Written(counted_urls(pages), "urls").df
    rows = distinct.agg(F.sum("n")).first()[0] or 0
    found = Written(pattern_verdicts(distinct, pattern_rules), "matched").df
    hot = [r.url for r in distinct.filter((F.col("n") * HOT > rows) & (F.col("n") > LEAST)).select("url").collect()]  # fewer than HOT
    is_hot = F.coalesce(F.col("url").isin(hot), F.lit(False)) if hot else F.lit(False)
    usual = ruled.filter(F.col("url").isNotNull() & ~is_hot).join(found.filter(~is_hot), "url", "left")
    none = F.lit(None).cast("string")
    out = usual.unionByName(ruled.filter("url is null").withColumns({"pattern": none, "pattern_verdict": none}))
    if hot:
        out = out.unionByName(ruled.filter(is_hot).join(F.broadcast(found.filter(is_hot)), "url", "left"))
    out = out.withColumn("verdict", F.coalesce("ruled", "pattern_verdict", F.lit("allow")))
    return out.select(*[F.col(f"own.`{c}`").alias(c) for c in own], *added)


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _oracle() -> str:
    cases = lambda what: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what((v, h, p))}'" for v, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2])))
    order = sorted(enumerate(PATTERN_RULES), key=lambda r: (r[1][1] != "block", r[0]))
    tests = lambda what: "CASE " + " ".join(f"WHEN regexp_matches(low, '{r[2]}') AND list_has_all(tokens, {r[3]}) THEN '{what(r)}'" for _, r in order) + " END"
    return f"""
WITH a AS (SELECT page_id, lower(coalesce(regexp_extract(url, '{_HOST}', 1, 's'), '')) AS host, coalesce(regexp_extract(url, '{_REST}', 1, 's'), '') AS path,
  lower(url) AS low, regexp_extract_all(lower(url), '[a-z0-9_]+') AS tokens FROM pages),
b AS (SELECT page_id, host, path, CASE {cases(lambda r: r[1] + r[2])} END AS rule, CASE {cases(lambda r: r[0])} END AS by_rule,
  {tests(lambda r: r[0])} AS pattern, {tests(lambda r: r[1])} AS by_pattern FROM a)
SELECT page_id, host, path, rule, coalesce(by_rule, by_pattern, 'allow') AS verdict, pattern FROM b
"""


ORACLE = _oracle()
