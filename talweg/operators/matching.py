"""Engine A whole: candidates against structured needs, six parts of together at most 100 points, from columns alone.

Pairs come from queries_in_blocks(), so needs are a stated set and candidates aren't shuffled. Skills are compared as they
stand: resolve aliases first, with labels.canonical(). Nulls count as what isn't told; repeated rows are scored each.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.functions import scores
from talweg.operators.blocks import numbered
from talweg.sources.tables import stored

#: Skills that count as cloud, and what contract names stand for any.
CLOUD = ("aws", "azure", "gcp", "cloud", "databricks", "snowflake", "kubernetes", "docker")
ANY_CONTRACT = ("tous", "all", "")
LIKE, NEAR_PLACE, RETAINED = 0.82, 0.7, 80.0
PARTS = ("skills", "title", "seniority", "availability", "missions", "bonus")


@F.pandas_udf(T.ArrayType(T.StringType()))
def lacking(required: pd.Series, has: pd.Series) -> pd.Series:
    """The required skills that no skill there equals, holds, is held by, or is like by matching blocks over 0.82."""
    known: dict[tuple[str, str], bool] = {}

    def like(r: str, s: str) -> bool:
        if (r, s) not in known:
            # Twice the characters in common over all: what this bound excludes needs no blocks.
            possible = 2 * min(len(r), len(s)) > LIKE * (len(r) + len(s))
            known[r, s] = r in s or s in r or (possible and difflib.SequenceMatcher(None, r, s).ratio() > LIKE)
        return known[r, s]

    out = []
    for needed, there in zip(required, has, strict=True):
        there = [s.lower() for s in there if s is not None] if there is not None else []
        out.append([r for r in needed if r is not None and not any(like(r.lower(), s) for s in there)] if needed is not None else [])
    return pd.Series(out)


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def scored(pairs: DataFrame) -> DataFrame:
    """`pairs` with a column for each of PARTS, missing (skills) and total.

    A pair has of its need: need_title, required, least (years), level, client, sector, context, languages, place,
    remote, contract; and of its candidate: title, skills, years, status, text (all there is), done (texts of missions),
    spoken, certificates (a number), home.
    """
    required = F.filter(_list("required"), lambda r: r.isNotNull())
    out = pairs.withColumn("missing", lacking(required, _list("skills")))
    share = 1 - F.size("missing") / F.nullif(F.size(required), F.lit(0))
    skills = F.coalesce(scores.two_places(share * scores.WEIGHTS["skills"]), F.lit(float(scores.WEIGHTS["skills"])))
    overlap = scores.keyword_overlap(_low("need_title"), _low("text"))
    title = F.when(_low("need_title") != "", scores.title_score(scores.ratio(_low("need_title"), _low("title")), overlap)).otherwise(0.5 * scores.WEIGHTS["title"])
    years, least = F.coalesce("years", F.lit(0)), F.coalesce("least", F.lit(0))
    signals = [F.when(F.trim(_low(c)) != "", scores.keyword_overlap(_low(c), _low("text"))) for c in ("client", "sector", "context")]
    used = F.size(F.filter(required, lambda r: F.contains(_low("done"), F.lower(r)))) / F.nullif(F.size(required), F.lit(0))
    language = F.exists(_list("languages"), lambda x: F.contains(_low("spoken"), F.lower(x)))
    cloud = F.exists(F.array(*map(F.lit, CLOUD)), lambda k: F.contains(F.lower(F.array_join(_list("skills"), " ")), k))
    asked, home = _low("place"), _low("home")
    both = (asked != "") & (home != "")
    place = both & (F.contains(home, asked) | F.contains(asked, home) | (scores.ratio(asked, home) > NEAR_PLACE))
    remote = both & _low("remote").rlike("remote|flex")
    contract = ~_low("contract").isin(*ANY_CONTRACT) & F.contains(_low("text"), _low("contract"))
    out = out.withColumns(
        {
            "skills_points": skills,
            "title_points": title,
            "seniority_points": scores.seniority_score(_low("level"), least, years),
            "availability_points": scores.availability_score(_low("status")),
            "missions_points": scores.missions_score(*signals, used),
            "bonus_points": scores.bonus_score(F.coalesce(language, F.lit(False)), F.coalesce("certificates", F.lit(0)) > 0, cloud, place, remote, contract).cast("double"),
        }
    )
    whole = sum((F.col(f"{p}_points") for p in PARTS), start=F.lit(0.0))
    return out.withColumn("total", F.least(F.lit(100.0), scores.two_places(whole)))


def reaches(threshold: float = RETAINED) -> Column:
    return F.coalesce(F.col("total") >= threshold, F.lit(False))


def ranked(rows: DataFrame, need: str, candidate: str, threshold: float = RETAINED) -> DataFrame:
    """`rows` with band, and rank in the need by total, then candidate; those under the threshold have none."""
    own = stored(rows, "scored")
    return placed(own.where(reaches(threshold)), own.where(~reaches(threshold)), need, candidate)


def placed(retained: DataFrame, others: DataFrame, need: str, candidate: str) -> DataFrame:
    """As ranked(), of what is retained and what isn't: the others need no order, so only what is retained is moved."""
    numbers = numbered(retained, need, [F.desc("total"), F.col(candidate)], "rank")
    return numbers.unionByName(others.withColumn("rank", F.lit(None).cast("int"))).withColumn("band", scores.band_a(F.col("total")))


def by_relevance(rows: DataFrame, similarity: Column, reranked: Column | None = None) -> DataFrame:
    """scored() rows with title and missions by relevance: a vector's similarity, else a reranker's score, both held between
    0 and 1, else the local points as they are. Adds relevance (three places, null if local) and source; the total is anew."""
    given = [(similarity, "semantic"), *([(reranked, "rerank")] if reranked is not None else [])]
    there = lambda c: c.isNotNull() & ~F.isnan(c)
    held = F.coalesce(*(F.when(there(c), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))) for c, _ in given))
    source = F.coalesce(*(F.when(there(c), name) for c, name in given), F.lit("local"))
    out = rows.withColumns({"_held": held, "source": source})
    points = {f"{p}_points": F.coalesce(scores.two_places(F.col("_held") * scores.WEIGHTS[p]), F.col(f"{p}_points")) for p in ("title", "missions")}
    out = out.withColumns({**points, "relevance": F.floor(F.col("_held") * 1000 + 0.5) / 1000}).drop("_held")
    whole = sum((F.col(f"{p}_points") for p in PARTS), start=F.lit(0.0))
    return out.withColumn("total", F.least(F.lit(100.0), scores.two_places(whole)))
