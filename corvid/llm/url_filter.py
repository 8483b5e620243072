"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

Everything on rows is a DataFrame expression; the model is a literal array of
weights fitted from the small labelled table below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.frames import unused

#: Rule string -> verdict. A rule is host + path prefix; it holds for the host and all its subdomains.
RULES = {
    "com/en/": "block",
    "example.com/en/7": "allow",
    "net/de/": "allow",
    "example.net/de/8": "block",
    "org/es/": "block",
}

#: The labelled URL table: 1 stands for block.
LABELLED = [
    ("https://en.encyclopedia.example/wiki/Linear_algebra", 0),
    ("https://docs.library.example/en/stable/tutorial.html", 0),
    ("http://www.university.example/physics/lecture/12", 0),
    ("https://news.daily.example/world/2021/05/economy-report", 0),
    ("https://blog.engineer.example/posts/how-compilers-work", 0),
    ("https://recipes.kitchen.example/bread/sourdough-guide", 0),
    ("https://www.museum.example/collection/item/4471", 0),
    ("https://forum.gardening.example/thread/9981?page=2", 0),
    ("https://journal.science.example/articles/10233/abstract", 0),
    ("http://city.gov.example/services/library/hours", 0),
    ("https://m.weather.example/forecast/week", 0),
    ("https://history.archive.example/letters/1892.html", 0),
    ("https://www.hospital.example/patients/guide/", 0),
    ("https://code.project.example/docs/install#linux", 0),
    ("https://travel.region.example/fr/montagnes/sentiers", 0),
    ("https://schule.example/de/unterricht/biologie", 0),
    ("https://biblioteca.example/es/libros/novela", 0),
    ("https://maths.example/fr/cours/algebre/3", 0),
    ("https://blog.orchestra.example/2019/season-opening", 0),
    ("http://www.bookbinding.example/articles/sewing.html", 0),
    ("http://cheap-pills-online.example/buy/viagra-discount", 1),
    ("http://free-casino-bonus.example/slots/win-now?ref=aff", 1),
    ("https://xxx-hot-videos.example/porn/free-sex-clip", 1),
    ("http://best-payday-loans.example/apply-now/fast-cash", 1),
    ("http://replica-watches.example/rolex/cheap/sale", 1),
    ("https://click-track.example/ads/redirect?aff=99&utm=spam", 1),
    ("http://win-iphone-prize.example/claim/free/gift", 1),
    ("https://poker-betting.example/casino/jackpot/bonus", 1),
    ("http://adult-cams.example/live/sex/nude-girls", 1),
    ("http://seo-backlinks.example/buy-links/cheap", 1),
    ("https://crack-keygen.example/download/warez/serial", 1),
    ("http://weight-loss-miracle.example/pills/order-now", 1),
    ("https://torrent-free.example/download/full-movie-hd", 1),
    ("http://bitcoin-doubler.example/invest/profit/guaranteed", 1),
    ("https://porn-tube.example/xxx/teen/video", 1),
    ("http://spam-offers.example/discount/viagra/coupon", 1),
    ("https://online-slots.example/bet/casino/free-spins", 1),
    ("http://escort-girls.example/adult/nude/hot", 1),
    ("http://fake-diploma.example/buy/degree/cheap", 1),
    ("https://popunder-ads.example/banner/click/redirect", 1),
]

BUCKETS = 1 << 12
SIZES = (3, 4)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: both empty for null or without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)
    return lower_ascii(host), path


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, its verdict), both null where no rule fits. The longest rule string wins, then the first by name."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in sorted(rules, key=lambda r: (len(r), r)):
        cut = name.find("/") if "/" in name else len(name)
        at_host, at_path = lower_host(name[:cut]), name[cut:]
        fits = ((host == at_host) | F.endswith(host, F.lit(f".{at_host}"))) & F.startswith(path, F.lit(at_path))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(rules[name])).otherwise(verdict)
    return rule, verdict


def lower_host(host: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)


def bucket(text: Column, n: int, tag: str):
    """Position in `text` -> hash bucket of the n-gram that begins there."""
    return lambda i: (F.crc32(F.encode(F.concat(F.lit(tag), F.substr(text, i, F.lit(n))), "UTF-8")) % BUCKETS).cast("int")


def grams(host: Column, path: Column) -> Column:
    """Hash buckets of the character n-grams of `^host$` and `^path$`, host and path apart."""
    parts = []
    for tag, c in (("h", host), ("p", path)):
        text = F.concat(F.lit("^"), c, F.lit("$"))
        for n in SIZES:
            starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, bucket(text, n, tag)))
    return F.concat(*parts)


def fit(spark: SparkSession, labelled: list[tuple[str, int]] = LABELLED, epochs: int = 300, rate: float = 0.5, l2: float = 1e-3) -> tuple[list[float], float]:
    """(weights, bias) of the logistic regression.

    The labelled table is small by definition (at most 10,000 urls), so its
    hashed n-grams come to the driver and full-batch gradient steps run there.
    """
    if len(labelled) > 10_000:
        raise ValueError("the labelled url table is meant to be small: 10,000 rows at most")
    frame = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in labelled))))
    rows = frame.select("label", grams(*url_parts(F.col("url"))).alias("g")).collect()
    seen = []
    for r in rows:
        counts: dict[int, float] = {}
        for g in r.g:
            counts[g] = counts.get(g, 0.0) + 1.0
        norm = math.sqrt(len(r.g)) or 1.0
        seen.append((r.label, [(k, v / norm) for k, v in sorted(counts.items())]))
    weights, bias = [0.0] * BUCKETS, 0.0
    for _ in range(epochs):
        gradient, shift = {}, 0.0
        for label, features in seen:
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weights[k] * v for k, v in features))))) - label
            shift += miss
            for k, v in features:
                gradient[k] = gradient.get(k, 0.0) + miss * v
        bias -= rate * shift / max(1, len(seen))
        for k, g in gradient.items():
            weights[k] -= rate * (g / max(1, len(seen)) * 10 + l2 * weights[k])
    return weights, bias


def filter_urls(pages: DataFrame, url: str = "url", rules: dict[str, str] | None = None, threshold: float = 0.5, model: tuple[list[float], float] | None = None) -> DataFrame:
    """`pages` with host, path, rule, probability (of block) and verdict.

    The rule that fits decides; else the model blocks where its probability
    reaches `threshold`. Null urls, or urls without `://`, have an empty host
    and path and are judged by the model's prior on the empty strings. Rows are
    never dropped or merged; an input column with one of the five new names is
    replaced. An empty table gives an empty table.
    """
    weights, bias = model or fit(pages.sparkSession)
    judged, seen = unused(pages, "rule_verdict", "url_grams")
    host, path = url_parts(F.col(url))
    rule, verdict = rule_for(F.col("host"), F.col("path"), RULES if rules is None else rules)
    table = F.lit(weights)
    score = F.aggregate(seen, F.lit(0.0), lambda s, g: s + F.get(table, g))
    norm = F.sqrt(F.greatest(F.lit(1), F.size(seen)).cast("double"))
    return (
        pages.withColumns({"host": host, "path": path})
        .withColumns({"rule": rule, judged: verdict, seen: grams(F.col("host"), F.col("path"))})
        .withColumn("probability", 1 / (1 + F.exp(-(score / norm + bias))))
        .withColumn("verdict", F.coalesce(judged, F.when(F.col("probability") >= threshold, "block").otherwise("allow")))
        .drop(seen, judged)
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of `pages`."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "probability")
