"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for strings in a sensitive context.

Base kinds (assign, access, hex) are fixed patterns. The method adds a fourth kind, `novel`: a candidate is a run of
16 or more credential characters that begins at most 64 characters after a word of sensitive context (on its line or a
later one), or, after the head of a private key block, anywhere before the block's end. Where base spans take a part of a
run, what they leave is a candidate, if it has 12 characters or more. A candidate's marginal compressed size (the compressed surrounding text with it, less the surrounding text alone) is measured with a
zstandard compressor primed by a dictionary of identifiers, so that names, paths and repeated text cost next to
nothing while random strings cost nearly all their entropy. A candidate that costs at least `NOVEL_BYTES` bytes, and
at least `NOVEL_SHARE` of its length, is reported.

Texts that can hold no match are passed over by exact tests (no keyword, no AKIA, no run of 24 hex characters).
Spans are in code points, end exclusive. Null texts count as empty and have no spans; very long texts are scanned whole;
repeated rows are scanned each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import arrow_map, id_and_text, table

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need not be matched and dropped
_HEX_CHARS = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_KEYWORDS = (b"passw", b"secret", b"token", b"api")

#: Words that make what follows a candidate.
CONTEXT = ("auth", "bearer", "client_id", "connectionstring", "credential", "passphrase", "passwd", "password", "private", "pwd", "secret", "session", "signature", "token", "api_key", "apikey", "api key", "access key", "access_key")
_CONTEXT = re.compile("|".join(map(re.escape, CONTEXT)), re.ASCII | re.IGNORECASE)
_CONTEXT_BYTES = tuple(x.encode() for x in CONTEXT)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~.-]{16,}", re.ASCII)
_KEY_HEAD, _KEY_END = re.compile(r"[ A-Z]*KEY[ A-Z]*-----"), "-----END"
REACH, AROUND, NOVEL_BYTES, NOVEL_SHARE = 64, 200, 12, 0.6

#: Identifiers and usual text around them, with which the compressor is primed.
IDENTIFIERS = (
    "username password passwd secret token api_key apikey access_key client_id client_secret authorization bearer session cookie credential private public "
    "certificate signature connection_string database hostname localhost example.com http:// https:// www. .html .json .yaml .properties config settings "
    "environment variable export import return function class string integer boolean null true false default value name type version path file directory "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 ____ ---- ==== .... getElementById toString application/x-www-form-urlencoded "
)


class Novelty:
    """Marginal compressed bytes of a string in its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False)

    def cost(self, before: str, candidate: str, after: str) -> int:
        size = lambda x: len(self.compressor.compress(x.encode("utf-8", "surrogatepass")))
        return size(before + candidate + after) - size(before + after)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind."""
    raw = text.encode("utf-8", "surrogatepass")
    low, found = raw.lower(), []
    if any(k in low for k in _KEYWORDS):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"h" * 24 in raw.translate(_HEX_CHARS):
        found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Strings in a sensitive context, outside base spans, that the primed compressor can't shorten."""
    low = text.encode("utf-8", "surrogatepass").lower()
    if not any(k in low for k in _CONTEXT_BYTES):
        return []
    taken: list[list[int]] = []  # base spans, those that overlap made one
    for a, b, _ in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out, reach = [], 0
    # contexts come in order, so the next end of a key block, and what was searched without a find, hold for those after them
    key_end, empty = 0, 0
    for c in _CONTEXT.finditer(text):
        stop = c.end() + REACH
        if head := _KEY_HEAD.match(text, c.end()):
            if 0 <= key_end < head.end():
                key_end = text.find(_KEY_END, head.end())
            stop = max(stop, key_end)
        at = max(c.end(), reach)
        while at < stop:
            near = _CANDIDATE.search(text, max(at, empty - 15), stop + 15)
            if not near:
                empty = max(empty, min(stop + 15, len(text)))
                break
            start, end = _CANDIDATE.match(text, near.start()).span()
            at = reach = end
            for a, b in _left(start, end, taken):
                cost = novelty.cost(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND])
                if cost >= NOVEL_BYTES and cost >= NOVEL_SHARE * (b - a):
                    out.append((a, b, "novel"))
    return out


def _left(start: int, end: int, taken: list[list[int]]) -> list[tuple[int, int]]:
    """What `taken` (sorted, apart) leaves of a run: the whole, or parts of at least NOVEL_BYTES characters."""
    k = bisect.bisect_right(taken, [start]) - 1
    k = k if k >= 0 and taken[k][1] > start else k + 1
    out, at = [], start
    while k < len(taken) and taken[k][0] < end:
        out.append((at, taken[k][0]))
        at, k = max(at, taken[k][1]), k + 1
    return [(a, b) for a, b in [*out, (at, end)] if b - a >= NOVEL_BYTES]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and spans: arrays of (kind, start, end), by start, then kind."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    novelty: list[Novelty] = []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        novelty or novelty.append(Novelty())
        base, spans = [], []
        told = lambda found: [{"kind": k, "start": a, "end": b} for a, b, k in found]
        for text in batch.column(1).to_pylist():
            of = base_spans(text)
            base.append(told(of))
            spans.append(told(sorted(of + novel_spans(text, of, novelty[0]), key=lambda x: (x[0], KINDS.index(x[2])))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, pa.list_(span)), pa.array(spans, pa.list_(span))], names=["doc_id", "text", "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return arrow_map(id_and_text(docs), each, f"doc_id long, text string, base {kind}, spans {kind}")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """`text` with each span, or run of overlapping spans, replaced by [kind] of the first."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with secrets redacted in `text`, and n_chars, where there is one, of the redacted text."""
    novelty: list[Novelty] = []
    names = docs.columns

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        novelty or novelty.append(Novelty())
        out = []
        for text in batch.column(0).to_pylist():
            if text:
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base, novelty[0]), key=lambda x: (x[0], KINDS.index(x[2])))
                text = redact(text, spans) if spans else text
            out.append(text)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1)], names=["text", "row"])

    packed = docs.select(docs["text"].cast("string").alias("text"), F.struct(*[docs[c] for c in names if c != "text"], F.lit(1).alias("_one")).alias("row"))
    done = arrow_map(packed, each, packed.schema)
    return done.select(*[F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in names])


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", *map(count, KINDS[:3]), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
