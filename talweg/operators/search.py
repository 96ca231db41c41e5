"""Dictionary search: all terms of a table in all texts, the longest first, without overlaps.

Texts and terms are compared without case, accents and doubled white space; apostrophes and dashes of all kinds are one.
A hit stands between word borders: no letter, digit or underscore beside it, and beside terms of one or two characters no
plus, hash or full stop either, nor a plus or hash after a term that ends in one. A term may have vetoes, patterns that
void a hit where they match within `AROUND` characters around it. Of hits that overlap the longest counts, then the one
whose term comes first in order, then the one further left.

Terms of words become a tree of words in each Python worker, others an Aho-Corasick automaton, so a text is read once by each
whatever the number of terms. The
table of terms may be of any size: it is cut into blocks of about `BLOCK` bytes (measured: a tree of 66 MB, or an automaton of 35), one of
which is broadcast and held at a time; with more than one block the texts and the hits so far are written after each.
Hits are chosen per text, so nothing is shuffled and no term is a hot key.

Null and empty texts have no hit; a term without characters is ignored, and of terms that are alike the one with the
smallest name counts. Texts of any length are read whole, and positions are code points of the text as it is, end
exclusive. Rows that repeat have their hits repeated.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.sources.tables import stored

BLOCK, AROUND = 1 << 20, 18
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_") | {chr(c) for c in range(0xC0, 0x250)}
_WORD_RUN = re.compile("[a-z0-9_\u00c0-\u024f]+")
_WORDS = re.compile(f"{_WORD_RUN.pattern}(?: {_WORD_RUN.pattern})*")
_LIKE = {**dict.fromkeys("‘’′", "'"), **dict.fromkeys("‐‑‒–—―", "-")}
_SHOWN = ("start", "end", "alias", "name", "category", "weight")
_FIELDS = ("start", "end", "key", *_SHOWN[2:])
_HIT = "struct<start: int, end: int, alias: string, name: string, category: string, weight: double>"
_BY_PLACE = itemgetter(0, 1)
_FOUND = _HIT.replace("alias", "key: string, alias", 1)


class _Folded(dict):
    """What stands for each character: one character, without case and accents."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        low = unicodedata.normalize("NFD", c.lower())
        base = low[0] if len(low) == 1 or all(map(unicodedata.combining, low[1:])) else c
        self[code] = " " if c.isspace() or c == "_" else _LIKE.get(c, base)
        return self[code]


_FOLDED = _Folded()


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """The text in which terms are looked for; where runs of white space were cut in it, and how much before that."""
    flat = text.translate(_FOLDED)
    if "  " not in flat:
        return flat, [], []
    out, at, gone, last, lost = [], [], [], 0, 0
    for run in re.finditer("  +", flat):
        out.append(flat[last : run.start() + 1])
        last = run.end()
        lost += run.end() - run.start() - 1
        at.append(last - lost)
        gone.append(lost)
    return "".join([*out, flat[last:]]), at, gone


def term_key(alias: str) -> str:
    """A term as it is looked for."""
    return folded(alias)[0].strip().strip(".,;:!?").strip()


class _Dictionary:
    """One block of terms: (key, alias, name, category, weight, vetoes). Terms of words alone are met word by word, in a tree of
    words; an automaton, which stops at each place within words too, has the others."""

    def __init__(self, terms: list[tuple]):
        self.terms, self.automaton, self.words = terms, ahocorasick.Automaton(), {}
        for term in terms:
            key, vetoes = term[0], [re.compile(p) for p in term[5] or ()]
            extra = "+#." if len(key) <= 2 else ""
            if _WORDS.fullmatch(key):
                *path, last = key.split(" ")
                node = self.words
                for word in path:
                    entry = node.setdefault(word, [None, None])
                    node = entry[1] = entry[1] or {}
                node.setdefault(last, [None, None])[0] = (extra, term[:5], vetoes)
            else:
                self.automaton.add_word(key, (len(key), _WORD | set(extra), _WORD | set(extra or (key[-1] if key[-1] in "+#" else "")), term[:5], vetoes))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple]:
        """(start, end, key, alias, name, category, weight) of all that borders and vetoes allow."""
        out, near = [], lambda start, end: text[max(0, start - AROUND) : end + AROUND]
        places = [m.span() for m in _WORD_RUN.finditer(text)] if self.words else []
        for k, (start, end) in enumerate(places):
            node, after = self.words.get(text[start:end]), k
            while node:
                if found := node[0]:
                    extra, term, vetoes = found
                    if not (extra and (start and text[start - 1] in extra or text[end : end + 1] and text[end] in extra)) and not (vetoes and any(v.search(near(start, end)) for v in vetoes)):
                        out.append((start, end, *term))
                after += 1
                if not node[1] or after == len(places) or places[after][0] != end + 1 or text[end] != " ":
                    break
                node, end = node[1].get(text[end + 1 : places[after][1]]), places[after][1]
        for last, (size, before, after, term, vetoes) in self.automaton.iter(text) if len(self.automaton) else ():
            start, end = last + 1 - size, last + 1
            if not (start and text[start - 1] in before or end < len(text) and text[end] in after) and not (vetoes and any(v.search(near(start, end)) for v in vetoes)):
                out.append((start, end, *term))
        return out


def chosen(hits: list[tuple]) -> list[tuple]:
    """Those that remain if the longest come first and none overlap, from left to right. Hits compete only within their run of overlapping ones."""
    out, run, reach = [], [], 0
    for hit in sorted(hits, key=_BY_PLACE):
        if hit[0] >= reach and run:
            out += run if len(run) == 1 else _longest(run, reach)
            run = []
        run.append(hit)
        reach = max(reach, hit[1])
    return out + (run if len(run) < 2 else _longest(run, reach))


def _longest(run: list[tuple], reach: int) -> list[tuple]:
    first, out = run[0][0], []
    taken = bytearray(reach - first)
    for hit in sorted(run, key=lambda h: (h[0] - h[1], h[2], h[0])):
        if taken.find(1, hit[0] - first, hit[1] - first) < 0:
            taken[hit[0] - first : hit[1] - first] = b"\1" * (hit[1] - hit[0])
            out.append(hit)
    return sorted(out, key=_BY_PLACE)


def _place(x: int, at: list[int], gone: list[int]) -> int:
    """A position of the folded text as one of the text itself."""
    k = bisect_right(at, x)
    return x + gone[k - 1] if k else x


def _blocks(terms: DataFrame) -> Iterator[tuple[int, list[tuple]]]:
    """How many blocks of about BLOCK bytes the terms make, and each of them, fetched when its turn comes."""
    have = lambda c, t: F.col(c).cast(t) if c in terms.columns else F.lit(None).cast(t)
    key = F.udf(term_key, "string", useArrow=False)
    known = terms.where("alias is not null").select(key("alias").alias("key"), F.struct("name", "alias", have("category", "string").alias("category"), have("weight", "double").alias("weight"), have("vetoes", "array<string>").alias("vetoes")).alias("t"))
    known = known.where("key != ''").groupBy("key").agg(F.min("t").alias("t"))
    n = -(-int(known.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()[0]) // BLOCK) or 1
    for k in range(n):
        part = known.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k).orderBy("key").select("key", "t.alias", "t.name", "t.category", "t.weight", "t.vetoes")
        yield n, [tuple(r) for r in part.collect()]


def with_hits(texts: DataFrame, text: Column, terms: DataFrame, overlaps: bool = False) -> DataFrame:
    """row (all columns of `texts`) and hits, those of the column `text` from left to right.

    `terms` has alias and name, and may have category, weight and vetoes (array of patterns over folded text). With
    `overlaps` all hits that borders and vetoes allow are given.
    """
    spark: SparkSession = texts.sparkSession
    for name, most in (("maxRecordsPerBatch", 1024), ("maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    packed = texts.select(F.struct(*[texts[c] for c in texts.columns]).alias("row"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast(f"array<{_FOUND}>").alias("found"))
    schema, row = packed.schema, packed.schema["row"]
    final = T.StructType([row, T.StructField("hits", T.StructType.fromDDL(f"h array<{_HIT}>")["h"].dataType)])
    types = {"start": pa.int32(), "end": pa.int32(), "weight": pa.float64()}

    def listed(texts: list[list[tuple]], names: tuple[str, ...], at: tuple[int, ...]) -> pa.ListArray:
        """The hits of each text, made column by column: one object a hit would cost more than finding it."""
        columns = list(zip(*chain.from_iterable(texts), strict=True)) or [()] * len(_FIELDS)
        offsets = pa.array([0, *accumulate(map(len, texts))], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(columns[k], types.get(x, pa.string())) for x, k in zip(names, at, strict=True)], names))

    def step(block: list[tuple], last: bool):
        shared = spark.sparkContext.broadcast(block)

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Dictionary(shared.value)
            for batch in batches:
                out = []
                for value, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    flat, at, gone = folded(value)
                    found = known.hits(flat) if known.terms else []
                    if before:
                        found += [tuple(h.values()) for h in before]
                    if last:
                        found = sorted(found) if overlaps else chosen(found)
                        if at:
                            found = [(_place(h[0], at, gone), _place(h[1] - 1, at, gone) + 1, *h[2:]) for h in found]
                    out.append(found)
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), listed(out, _SHOWN, (0, 1, *range(3, len(_FIELDS))))], names=["row", "hits"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed(out, _FIELDS, tuple(range(len(_FIELDS))))], names=["row", "text", "found"])

        return over

    for k, (n, block) in enumerate(_blocks(terms)):
        last = k == n - 1
        packed = packed.mapInArrow(step(block, last), final if last else schema)
        if not last:
            packed = stored(packed, "search")
    return packed


def find_terms(texts: DataFrame, keys: list[str], text: str, terms: DataFrame, overlaps: bool = False) -> DataFrame:
    """The columns `keys` of each text and start, end, alias, name, category, weight of each of its hits."""
    own = texts.select(F.struct(*keys).alias("key"), F.col(text).alias("text"))
    return with_hits(own, own["text"], terms, overlaps).select("row.key.*", F.explode("hits").alias("hit")).select(*keys, "hit.*")
