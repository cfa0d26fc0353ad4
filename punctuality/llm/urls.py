"""URL filters: rules of a host and a path decide what becomes of a URL.

A rule fits its host and all subdomains, if the URL's path starts with the rule's. Each
URL is expanded into expressions: every suffix of its host's labels with every prefix of
its path at which a rule can end. Expressions and rules meet in an equi-join on the first
bytes of a digest; the full digests are compared after it, and of the rules that fit the
longest wins. All of it is built-in functions.

How far URLs are expanded the rules tell: deeper than the deepest rule nothing can fit, so
that nothing is lost and long hosts and paths don't multiply. The rules are broadcast
while they are within MOST_RULES rows and MOST_BYTES bytes, both counted before; beyond
that they are dealt by digest, and those that many URLs ask for are joined apart. A URL's
expressions come together again under a number of its row, so no host or URL makes a hot key.

Defined results: a null URL, or one without "://", has an empty host and path; hosts of
URLs and rules are compared in lower case (A-Z only); ports and user names are part of the
host as it stands; an empty path starts with no rule's but an empty one. Length is that of
host and path in characters; of equal lengths the longer host wins, and of rules that are
equal but for the verdict block. Rules with a null host, path or verdict fit nothing. No
rule fits: the verdict is `default` (allow, as the rules name what is known). Repeated
rows each get a row; an empty table of pages gives an empty result, one of rules gives
every page the default; other columns are kept out, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctuality.llm.shared import join_skewed, written

MOST_RULES, MOST_BYTES = 200_000, 16 << 20
#: Hexadecimal digits of the digest that are joined on: 32 bits.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("host", "path", "verdict")
#: A rule's precedence in one number, so that the best is a plain maximum: total length,
#: length of the host, whether it blocks.
_WIDTH = 1 << 20


def rules_of(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Rules that are settings, as a table: (host, path, allow or block)."""
    each = [F.struct(*[F.lit(v).cast("string").alias(c) for v, c in zip(row, FIELDS, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*each)))


def parts(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path of a URL."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    """Of a host and a path; a host has no slash, so a line break after it is no part of either."""
    return F.sha2(F.concat(host, F.lit("\n/"), path), 256)


def known(rules: DataFrame) -> DataFrame:
    """(host, path, blocks): each different rule once; of two verdicts block counts."""
    host = F.translate("host", UPPER, LOWER)
    whole = rules.where("host is not null and path is not null and verdict is not null")
    return whole.groupBy(host.alias("host"), "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))


def keyed(rules: DataFrame) -> DataFrame:
    """(short, fits): the rules of each short digest, as an array of all of them (full
    digest and precedence). Different rules share 32 bits by chance alone, so it is short."""
    host, path = F.char_length("host").cast("long"), F.char_length("path").cast("long")
    weight = ((host + path) * _WIDTH + host) * 2 + F.col("blocks").cast("long")
    rows = rules.select(digest(F.col("host"), F.col("path")).alias("full"), weight.alias("weight"))
    return rows.groupBy(F.left("full", F.lit(SHORT)).alias("short")).agg(F.collect_list(F.struct("full", "weight")).alias("fits"))


def expressions(host: Column, path: Column, labels: int, depth: int, lengths: list[int]) -> Column:
    """The digests of a URL's expressions: suffixes of up to so many labels, with the
    prefixes that end at one of the first slashes and those of the given lengths."""
    names, steps = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda n: F.array_join(F.slice(names, -n, n), "."))
    slashes = F.least(F.size(steps) - 1, F.lit(depth))
    one = lambda n: F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))
    none = F.array().cast("array<string>")
    at_slashes = F.when(slashes > 0, F.transform(F.sequence(F.lit(1), F.greatest(slashes, F.lit(1))), one)).otherwise(none)
    ends = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    inside = F.transform(F.filter(ends, lambda n: n <= F.char_length(path)), lambda n: F.left(path, n))
    prefixes = F.array_distinct(F.concat(at_slashes, inside))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: digest(s, p))))


def reach(rules: DataFrame) -> tuple[int, int, int, int, list[int]]:
    """Of the rules: how many, bytes, most labels, most slashes of those whose path ends
    with one, and the lengths of the other paths (as many as there are different lengths)."""
    whole = F.col("path").endswith("/")
    row = rules.agg(
        F.count("*"),
        F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)),
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)),
        F.coalesce(F.max(F.when(whole, F.size(F.split("path", "/")) - 1)), F.lit(0)),
        F.collect_set(F.when(~whole, F.char_length("path"))),
    ).first()
    return row[0], row[1], row[2], row[3], sorted(row[4])


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row a page: id_col, host, path, rule (host and path as one text; null if none
    fits), verdict."""
    rules = known(rules)
    count, size, labels, depth, lengths = reach(rules)
    host, path = parts(F.col(url_col).cast("string"))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    asked = urls.withColumn("full", F.explode_outer(expressions(F.col("host"), F.col("path"), labels, depth, lengths)))
    asked = asked.withColumn("short", F.left("full", F.lit(SHORT)))
    if count <= MOST_RULES and size <= MOST_BYTES:
        met = asked.join(F.broadcast(keyed(rules)), "short", "left")
    else:
        met = join_skewed(written(asked, "url-expressions"), keyed(rules), "short", "left")
    fits = F.filter("fits", lambda rule: rule["full"] == F.col("full"))
    best = met.withColumn("weight", fits[0]["weight"]).groupBy("row", "id", "host", "path").agg(F.max("weight").alias("weight"))
    own = (F.shiftright("weight", 1) % _WIDTH).cast("int")
    rule = F.concat(F.right("host", own), F.left("path", F.shiftright("weight", 21).cast("int") - own))
    verdict = F.when(F.col("weight").isNull(), default).when(F.col("weight") % 2 == 1, "block").otherwise("allow")
    return best.select(F.col("id").alias(id_col), "host", "path", F.when(F.col("weight").isNotNull(), rule).alias("rule"), verdict.alias("verdict"))
