"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

Everything over the table is SQL functions: the features of a URL are the md5 buckets of the 3- and 4-character
runs of ``^host|path$``, its score a dot product with a literal weight array. Only the fit of the small labelled
table (at most ``MAX_LABELLED`` rows) runs on the driver, on features that the same expressions made.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no rule and gets the verdict of the
intercept; repeated rows stay; columns other than those named in the result are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import kept_names

#: (host, path, verdict): a rule fits its host and every subdomain if the path starts with the rule's.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

BUCKETS = 4096
MAX_LABELLED = 5000
MAX_RULES = 1000
STEPS, RATE, DECAY = 400, 1.0, 1e-3

#: The labelled URL table, 1 for those to block.
LABELLED = [
    ("http://spam-mills.example.org/en/1", 1), ("https://www.spam-mills.example.com/de/22", 1), ("http://m.spam-mills.info/fr/7.html", 1),
    ("https://spam.example.com/es/60", 1), ("http://mail.spam-links.example.org/es/48?utm_source=feed", 1), ("https://discount-pills.example.com/fr/3", 1),
    ("http://m.discount-pills.info/en/44#top", 1), ("https://www.cheap-meds.example.org/en/12", 1), ("http://pills-online.example.com/es/8", 1),
    ("https://buy-pills.example.org/de/71/", 1), ("http://casino-jackpot.example.org/en/5", 1), ("https://m.casino-jackpot.info/en/91.html", 1),
    ("http://www.casino-bonus.example.com/es/17", 1), ("https://online-casino.example.com/fr/2", 1), ("http://blog.free-casino.example.org/en/33", 1),
    ("http://betting-tips.example.org/en/70", 1), ("https://m.betting-tips.info/es/6/", 1), ("http://www.best-bets.example.com/en/28", 1),
    ("https://sports-bets.example.org/fr/54", 1), ("http://free-prizes.example.com/en/19?page=2", 1), ("http://ad-tracker.example.org/en/64", 1),
    ("https://m.ad-tracker.info/fr/10", 1), ("http://www.ads-click.example.com/en/37", 1), ("https://track-ads.example.org/es/21.html", 1),
    ("http://blog.click-track.example.com/de/9", 1), ("http://adult-chat.example.org/en/4", 1), ("https://www.adult-chat.info/fr/88/", 1),
    ("http://adult-videos.example.com/es/13", 1), ("https://m.adult-cams.example.org/en/55", 1), ("http://hot-adult.example.com/en/29#top", 1),
    ("http://warez-crack.example.com/en/31", 1), ("https://www.phish-login.example.org/en/2", 1), ("http://payday-loans.example.com/fr/43", 1),
    ("https://link-farm.example.org/es/3", 1), ("http://seo-links.example.com/en/14", 1),
    ("http://thunder.example.com/en/676", 0), ("https://blog.rivers.example.org/en/853/", 0), ("https://m.station.example.com/en/474.html", 0),
    ("http://england.example.org/fr/533", 0), ("https://www.example.com/", 0), ("http://docs.example.org/guide/intro", 0),
    ("https://news.example.com/2024/05/01/story", 0), ("http://wiki.example.org/wiki/Main_Page", 0), ("http://example.org/es/15", 0),
    ("https://shop.example.com/catalog/chairs", 0), ("http://university.example.org/courses/math", 0), ("https://blog.rhineland.example.com/fr/9", 0),
    ("https://m.theatre.example.org/es/231?page=2", 0), ("http://library.example.com/books/1001", 0), ("https://museum.example.org/en/visit", 0),
    ("http://city.example.com/transport/timetable", 0), ("https://recipes.example.org/soup/12", 0), ("http://forum.example.com/thread/42#top", 0),
    ("https://weather.example.org/en/berlin", 0), ("https://harbour.example.com/es/77?ref=x", 0), ("http://www.mountain.example.org/en/64", 0),
    ("https://m.leather.example.com/fr/10", 0), ("http://blog.andes.example.com/en/37", 0), ("https://pantheon.example.org/es/21.html", 0),
    ("http://www.aesthetics.example.com/en/9", 0), ("https://handball.example.org/en/4/", 0), ("http://m.parenting.example.com/fr/88", 0),
    ("https://panther.example.com/es/13?utm_source=feed", 0), ("http://blog.hosting.example.org/en/55", 0), ("https://www.leander.example.com/en/29#top", 0),
    ("http://garden.example.info/en/31", 0), ("https://www.schule.example.info/es/2", 0), ("http://bakery.example.com/fr/43", 0),
    ("https://m.music.example.org/es/3", 0), ("http://travel.example.com/en/14", 0), ("https://thimble.example.org/en/1", 0),
    ("http://www.radio.example.com/en/22", 0), ("https://thoughts.example.com/fr/7.html", 0), ("http://m.athlete.example.org/en/60", 0),
    ("https://minerals.example.com/en/48", 0),
    ("http://m.org/en/7", 0), ("https://go.com/", 0), ("http://ab.org/en/", 0),
    ("https://tv.info/fr/2", 0), ("http://bio.org/en/15", 0), ("https://lab.com/es/", 0),
    ("http://localhost/", 0), ("https://intranet/en/start", 0), ("http://10.0.0.1/x", 0), ("plain text", 0),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _runs(text: Column, k: int) -> Column:
    starts = F.when(F.length(text) >= k, F.sequence(F.lit(1), F.length(text) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(k)))


def buckets(host: Column, path: Column, n: int = BUCKETS) -> Column:
    """The sorted distinct buckets of the 3- and 4-character runs of ``^host|path$``."""
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    runs = [_runs(text, k) for k in (3, 4)]
    number = lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 6), 16, 10).cast("int") % n
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(F.concat(*runs)), number)))


def fit(examples: list[tuple[list[int], float]], n: int = BUCKETS) -> list[float]:
    """Weights of the buckets and, last, the intercept: full-batch gradient descent on binary features."""
    if len(examples) > MAX_LABELLED:
        raise ValueError(f"the labelled table has {len(examples)} rows; the bound is {MAX_LABELLED}")
    w = [0.0] * (n + 1)
    for _ in range(STEPS if examples else 0):
        step: dict[int, float] = {}
        for x, y in examples:
            scale = 1 / math.sqrt(max(1, len(x)))
            e = y - 1 / (1 + math.exp(-(w[n] + scale * sum(w[b] for b in x))))
            for b in x:
                step[b] = step.get(b, 0.0) + e * scale
            step[n] = step.get(n, 0.0) + e
        for b, g in step.items():
            w[b] += RATE * (g / len(examples) * 4 - DECAY * w[b])
    return w


def train(labelled: DataFrame, n: int = BUCKETS) -> list[float]:
    """labelled: url, label. Rows with a null label are left out."""
    rows = labelled.filter("label is not null").select(buckets(host_of(F.col("url")), path_of(F.col("url")), n).alias("x"), F.col("label").cast("double").alias("y"))
    return fit(sorted((r.x, r.y) for r in rows.limit(MAX_LABELLED + 1).collect()), n)


def default_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED, "url string, label int")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]], value: int | None = None) -> Column:
    """The text (or verdict) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the bound is {MAX_RULES}")
    found = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last one set wins: the longest
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.lit(verdict if value else h + p)).otherwise(found)
    return found


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] | None = None, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep columns (one named as those to come: NAME_kept), host, path, rule, verdict (allow or block) and block_score (0 to 1) of every row."""
    rules = RULES if rules is None else rules
    w = train(labelled if labelled is not None else default_labels(pages.sparkSession))
    names = kept_names(keep, ("host", "path", "rule", "verdict", "block_score"))
    row = F.struct(F.lit(0).alias("__none"), *(F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True))).alias("row")
    parts = pages.select(row, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    x, weights, host, path = buckets(F.col("host"), F.col("path")), F.lit(w), F.col("host"), F.col("path")
    parts = parts.select("*", rule_for(host, path, rules).alias("rule"), rule_for(host, path, rules, 1).alias("ruled"), x.alias("x"))
    margin = F.aggregate("x", F.lit(0.0), lambda a, b: a + F.get(weights, b)) / F.sqrt(F.greatest(F.size("x"), F.lit(1))) + F.lit(w[-1])
    scored = parts.select("row", "host", "path", "rule", "ruled", (1 / (1 + F.exp(-margin))).alias("block_score"))
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict")
    return scored.select(*(F.col("row")[n].alias(n) for n in names), "host", "path", "rule", verdict, "block_score")


def oracle() -> str:
    """The same rows in DuckDB's SQL, with weights fitted on features that plain Python makes."""
    import hashlib
    import re

    def features(url: str) -> list[int]:
        m = re.match(PARTS, url)
        text = f"^{m[1].lower()}|{m[2]}$" if m else "^|$"
        grams = {text[i : i + k] for k in (3, 4) for i in range(len(text) - k + 1)}
        return sorted({int(hashlib.md5(g.encode()).hexdigest()[:6], 16) % BUCKETS for g in grams})

    w = fit(sorted((features(u), float(y)) for u, y in LABELLED))
    ruled = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v if k else h + p}'" for h, p, v in ruled) + " END"
    return f"""
WITH parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{PARTS}', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages),
texts AS (SELECT *, '^' || host || '|' || path || '$' AS t FROM parts),
grams AS (SELECT *, list_distinct(list_concat(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substring(t, i, 3)),
    list_transform(range(1, greatest(length(t) - 2, 1)), lambda i: substring(t, i, 4)))) AS g FROM texts),
feats AS (SELECT *, list_distinct(list_transform(g, lambda s: ('0x' || substring(md5(s), 1, 6))::INT % {BUCKETS})) AS x FROM grams),
judged AS (SELECT *, {w!r}::DOUBLE[] AS w FROM feats)
SELECT page_id, host, path, {case(0)} AS rule, coalesce({case(1)}, CASE WHEN
    coalesce(list_sum(list_transform(x, lambda b: w[b + 1])), 0) / sqrt(greatest(len(x), 1)) + w[{BUCKETS + 1}] >= 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""
