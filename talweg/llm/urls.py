"""URL filters: host and path rules, and a logistic regression on hashed character n-grams of host and path.

Everything on the rows is DataFrame functions. A rule names a host and a path prefix; it fits its host and all
subdomains, and the longest rule that fits decides. Where none fits, the model does: each run of three characters of
host or path is hashed (md5) to one of 4096 numbers, whose whole-number weights are summed; a sum over 0 blocks.
The model is trained, on the driver, from the small labelled table below: full-batch gradient descent with L2.

Null urls and those without `://` have an empty host and path, fit no rule and are judged by the intercept. Repeated
rows are judged each for itself; page_id may be null; very long urls are judged whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import table

BUCKETS, SCALE = 4096, 1000
#: (verdict, host and path prefix)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: The labelled table: host and path, 1 for what should be blocked. All of it is invented, on names reserved for examples.
LABELLED = tuple(
    [(x, 1) for x in (
        "spam-farm.test/en/12", "www.cheap-pills.example/buy/now", "cheap-meds.invalid/en/offer", "best-pills-online.test/order",
        "win-free-casino.example/bonus", "casino-bonus.invalid/slots/free", "hot-singles.test/join", "free-money-fast.example/click",
        "click-farm.invalid/ads/77", "link-farm.test/fr/3", "replica-watches.example/sale", "www.spam-links.invalid/en/1.html",
        "xxx-videos.test/watch", "adult-cams.example/live", "payday-loans.invalid/apply", "crypto-doubler.test/deposit",
        "seo-farm.example/backlinks", "cheap-viagra.invalid/en/4", "lottery-winner.test/claim", "spam.example/de/9",
        "malware-download.invalid/setup.exe", "free-download-crack.test/keygen", "pills.example/en/33/", "www.casino.invalid/poker",
        "get-rich-quick.test/now", "cheap-tickets-scam.example/pay", "doorway-pages.invalid/a/b", "spam-farm.test/en/700",
        "m.poker-casino.example/de/81", "blog.free-casino-spins.invalid/es/2", "www.win-big-lottery.test/fr/5/", "buy-cheap-pills.example/de/17.html",
        "cheap-replica-bags.invalid/sale/9", "free-xxx-cams.test/en/6", "fast-loans-online.example/apply-now", "win-a-phone.invalid/claim/now",
        "bitcoin-doubler.test/win", "click-here-to-win.example/bonus", "adult-singles-chat.invalid/join/free", "link-exchange-seo.test/links/free",
        "free-keygen-cracks.example/download/crack.exe", "m.slots-bonus.invalid/fr/40", "casino-slots.test/en/3", "pharmacy-no-prescription.example/pills",
    )]
    + [(x, 0) for x in (
        "www.townhall.test/en/12", "news.herald.example/world/2024/05", "blog.gardener.invalid/en/offer-letter", "docs.compiler.test/api/order",
        "library.example/books/7", "university.invalid/courses", "museum.test/join-us", "weather.example/today",
        "research.institute.invalid/papers/77", "m.timetable.test/de/3", "forum.example/thread/5521", "www.city-council.invalid/en/1.html",
        "video.lectures.test/watch", "radio.example/live", "jobs.invalid/apply", "bank.test/branches",
        "wiki.example/links", "health.invalid/en/4", "sports.test/results", "mail.example/de/9",
        "software.invalid/download", "blog.mountaineers.test/en/853/", "garden.example/en/33/", "blog.history.invalid/es/45",
        "recipes.test/now", "railway-tickets.example/timetable", "maps.invalid/a/b", "m.observatory.test/en/47.html",
        "theatre.example/en/770", "notation.invalid/fr/414", "blog.stationery.test/es/97", "www.shoreline.example/de/25",
        "bleached.invalid/en/81", "m.theories.test/de/17.html", "www.ancestors.example/fr/5/", "blog.nationhood.invalid/es/2",
        "ontology.test/en/6", "parish-records.example/de/40", "m.lighthouse.invalid/fr/404", "www.chemistry.test/en/3",
        "teaching.example/es/808/", "astronomy.invalid/en/9120", "blog.translation.test/de/5150", "m.weaving.example/fr/61.html",
    )]
)


def bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:3], 16)


def grams(host: str, path: str) -> list[str]:
    return [k + s[i : i + 3] for k, s in (("h", host), ("p", path)) for i in range(len(s) - 2)]


@lru_cache(1)
def weights(rounds: int = 400, rate: float = 0.05, l2: float = 0.01) -> tuple[tuple[int, ...], int]:
    """The weights of the 4096 numbers and the intercept, times SCALE, as whole numbers."""
    x, y = np.zeros((len(LABELLED), BUCKETS)), np.array([label for _, label in LABELLED], float)
    for row, (url, _) in zip(x, LABELLED, strict=True):
        host, slash, path = url.partition("/")
        for g in grams(host, slash + path):
            row[bucket(g)] += 1
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ error / len(y) * 10 + l2 * w)
        b -= rate * error.mean()
    return tuple(int(v) for v in np.round(w * SCALE)), int(np.round(b * SCALE))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty for null urls and those without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    upper = "".join(map(chr, range(65, 91)))
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for told, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = name.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(told)).otherwise(verdict)
    return rule, verdict


def model_score(host: Column, path: Column) -> Column:
    """The model's sum, times SCALE; over 0 blocks."""
    w, intercept = weights()
    every = F.expr(f"array({','.join(map(str, w))})")

    def total(kind: str, s: Column) -> Column:
        number = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(kind), F.substr(s, i, F.lit(3))).cast("binary")), 1, 3), 16, 10).cast("int")
        parts = F.when(F.length(s) >= 3, F.sequence(F.lit(1), F.length(s) - 2)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(parts, F.lit(0), lambda a, i: a + F.get(every, number(i)))

    return total("h", host) + total("p", path) + F.lit(intercept)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, score (the model's), verdict."""
    parts = pages.select(pages[id_col].alias("page_id"), *[c.alias(n) for n, c in zip(("host", "path"), split_url(pages[url_col].cast("string")), strict=True)])
    host, path = F.col("host"), F.col("path")
    rule, told = best_rule(host, path)
    judged = parts.select("page_id", "host", "path", rule.alias("rule"), told.alias("told"), model_score(host, path).alias("score"))
    return judged.select("page_id", "host", "path", "rule", "score", F.coalesce("told", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged."""
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    w, intercept = weights()
    digit = lambda k: f"(instr('0123456789abcdef', substr(g, {k}, 1)) - 1)"
    total = lambda kind, s: f"coalesce(list_sum(list_transform(list_transform(list_transform(range(1, greatest(length({s}) - 1, 1)), lambda i: md5('{kind}' || substr({s}, i, 3))), lambda g: {digit(1)} * 256 + {digit(2)} * 16 + {digit(3)}), lambda k: w[k + 1])), 0)"
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda name: f"(host = '{(h := name.partition('/'))[0]}' OR ends_with(host, '.{h[0]}')) AND starts_with(path, '/{h[2]}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[k]}'" for r in rules) + " END"
    return f"""WITH weights AS (SELECT {list(w)} AS w),
    rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
    parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
    scored AS (SELECT *, {case(1)} AS rule, {case(0)} AS told, {total("h", "host")} + {total("p", "path")} + ({intercept}) AS score FROM parts, weights)
    SELECT page_id, host, path, rule, coalesce(told, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM scored"""
