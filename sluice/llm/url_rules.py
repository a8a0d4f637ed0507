"""URL rules by hashed expressions: host suffixes x path prefixes, matched on short digests, confirmed in full.

A rule is ``host, path, action`` (``allow`` or ``block``); it fits its host and
all subdomains where the url's path starts with the rule's.  A rule path is
empty or ends with ``/``, so a fitting rule is one of the url's expressions: a
host suffix at a label boundary followed by a path prefix that ends in ``/``
(or nothing).  Both sides are hashed (SHA-256); the equi-join is on the first
four bytes, equal full digests confirm.  The longest expression wins; of two
rules with one expression ``block`` wins.

Only depths that some rule has are expanded (labels and slashes, two numbers per
distinct rule shape), so a url with thousands of dots or slashes makes no more
rows than rules can use, and nothing is cut off.  The join side is chosen by
Spark from its size (no forced broadcast); verdicts are found once per distinct
(host, path), so a url of a third of all rows is expanded once.

Defined results: null url or no ``://`` gives empty host and path and the
default verdict; A-Z of the host are lowered, nothing else is normalised
(ports and user parts belong to the host); repeated rows each get their verdict;
no rules means every row gets the default; extra columns pass through unless
they are named host, path, rule or verdict (those are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8  # four bytes
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return (pages.withColumn("host", F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER))
            .withColumn("path", F.regexp_extract(url, _PARTS, 2)))


def _labels(host):
    return F.size(F.split(host, r"\."))


def _slashes(path):
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def prepared(rules: DataFrame) -> DataFrame:
    """``expr, digest, short, action``, one row per expression; raises on a rule path that does not end with '/'."""
    host = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER)
    path = F.coalesce("path", F.lit(""))
    bad = rules.filter((host == "") | ((path != "") & ~(path.startswith("/") & path.endswith("/")))).limit(1).count()
    if bad:
        raise ValueError("a rule needs a host, and a path that is empty or starts and ends with '/'")
    return (rules.select(F.concat(host, path).alias("expr"), _labels(host).alias("labels"), _slashes(path).alias("slashes"), "action")
            .groupBy("expr", "labels", "slashes").agg(F.max("action").alias("action"))  # 'block' > 'allow'
            .withColumn("digest", F.sha2("expr", 256)).withColumn("short", F.substring("digest", 1, PREFIX_HEX)))


def expressions(urls: DataFrame, labels: list[int], slashes: list[int]) -> DataFrame:
    """One row per distinct (host, path) and expression of the given depths."""
    parts = F.col("parts")
    hosts = F.filter(F.transform(F.array(*[F.lit(int(k)) for k in labels]),
                                 lambda k: F.when(F.size(parts) >= k, F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))),
                     lambda h: h.isNotNull())
    paths = F.filter(F.transform(F.array(*[F.lit(int(k)) for k in slashes]),
                                 lambda k: F.when(k == 0, F.lit("")).when(F.col("depth") >= k, F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/")))),
                     lambda p: p.isNotNull())
    return (urls.select("host", "path").distinct().filter("host <> ''")
            .withColumn("parts", F.split("host", r"\.")).withColumn("depth", _slashes(F.col("path")))
            .select("host", "path", F.explode(hosts).alias("h"), paths.alias("paths"))
            .select("host", "path", "h", F.explode("paths").alias("p"))
            .withColumn("expr", F.concat("h", "p")).withColumn("digest", F.sha2("expr", 256))
            .withColumn("short", F.substring("digest", 1, PREFIX_HEX)).select("host", "path", "expr", "digest", "short"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; ``rule`` is null where none fits."""
    urls = split_url(pages.drop("host", "path", "rule", "verdict"))
    known = prepared(rules)
    shape = known.agg(F.sort_array(F.collect_set("labels")).alias("l"), F.sort_array(F.collect_set("slashes")).alias("s")).first()
    if not shape.l:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    r = known.select("short", F.col("digest").alias("full"), F.col("expr").alias("rule"), "action")
    hits = (expressions(urls, shape.l, shape.s).join(r, "short").filter(F.col("digest") == F.col("full"))
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
            .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action")))
    return (urls.join(hits, ["host", "path"], "left")
            .withColumn("verdict", F.coalesce("action", F.lit(default))).drop("action"))
