"""Conversation structure repair: a retained-subsequence DP over turns that are kept, reroled or deleted.

A conversation's rows stand in the order of their turns (null first; rows of one turn by role and text). A row's first
fault counts: blank, duplicate (its role and text stood earlier), truncated. The repaired conversation's role initials must
be `(s?(ua)+)?`. Keeping a row costs 0, reroling it 1, deleting it 2 (blank and duplicate rows must go), an empty turn of
user or assistant 5 where the initials need one, and a truncated row that stays 5.

The DP's state is the initial of the last retained row. Deletions since then are the same for all candidates, so of each
state only its running minimum is held; the pair of roles on both sides of a gap says what must be inserted in it. Among
equal costs the ASCII-least audit (the initials of the edits) wins: inserts stand right before the row that needs them, so
audits of equally many rows never begin one another, and the ranks of the four states' audits decide without their texts.
Costs and ranks, taken relative to the least, have few values, so most steps are lookups, and what a whole block of rows does
is a table of four times four costs and ranks: from each state before it to each after it. Conversations of at most `LONG` rows and `LONG_BYTES` bytes
are solved where they are sorted, one at a time. Longer ones never come together: duplicates are found by groups of (role,
text), rows are sorted by range and cut in blocks of `LONG` rows, each block makes its table, the tables (one per block) are
chained, and the blocks are solved again between the states so found. What such a conversation does come together for is
its own result: the audit, one letter a row, and its digest, which takes the sorted rows one by one in constant memory.

Null conv_ids are one conversation; nulls in role or text are one space. A conversation without rows after damage has
zeros, an empty audit and the hash of nothing. Rows that repeat are duplicates. A kept row with an empty role adds no
initial. Texts of any length are whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.llm.common import WHITE, bounded_batches, table, work_dir, written

LONG, LONG_BYTES = 10_000, 32 << 20
DELETE, INSERT, TRUNCATED, REROLE = 2, 5, 5, 1
BLANK, DUPLICATE, CUT = 1, 2, 3
FAR, HOPELESS = 1 << 40, 20
NONE = (FAR, 0)
STATES = ("", "s", "u", "a")
#: For each state the initials that inserts may lead to from it, with the inserted roles.
INSERTS = {"": ["", "u", "ua"], "s": ["", "u", "ua"], "u": ["", "a", "au"], "a": ["", "u", "ua"]}
#: The roles that may follow each state.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
LAST = {"": "", "s": "ua", "u": "a", "a": ""}
NAMES = {"u": "user", "a": "assistant"}
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@lru_cache(None)
def edits(initial: str, fault: int) -> list[tuple[int, int, int, str, str]]:
    """(from, to, cost, letters, inserted and own roles) of all that may happen to a row: states are numbers, the own role is `-` if kept and missing if deleted."""
    out = [(k, k, DELETE, "D", "") for k in range(len(STATES))]
    if fault in (BLANK, DUPLICATE):
        return out
    extra = TRUNCATED if fault == CUT else 0
    for k, state in enumerate(STATES):
        for put in INSERTS[state]:
            at = put[-1:] or state
            own = [("K", "-", initial, 0)] if initial == "" or initial in NEXT[at] else []
            own += [("R", r, r, REROLE) for r in "ua" if r != initial and r in NEXT[at]]
            for letter, role, to, cost in own:
                out.append((k, STATES.index(to or at), cost + extra + INSERT * len(put), "I" * len(put) + letter, put + role))
    return out


@lru_cache(100_000)
def step(now: tuple, initial: str, fault: int) -> tuple[tuple, tuple, tuple]:
    """What a row does to `now`: vectors of each state's (cost over the vector's least, rank of its audit among all). The new ones, what
    each one's least grew by, and for each vector and state (from, letters, roles).

    States that cost more than HOPELESS over the least are left: from the cheapest state all that may follow costs at most
    a deleted row, an insert before the next retained one and two at the end more than from any other.
    """
    best: list = [[None] * len(STATES) for _ in now]
    for a, b, cost, letters, roles in edits(initial, fault):
        for own, found in zip(now, best, strict=True):
            if own[a][0] < FAR:
                one = (own[a][0] + cost, own[a][1], letters, a, roles)
                found[b] = min(found[b] or one, one)
    audits = sorted({x[1:3] for found in best for x in found if x})
    least = tuple(min(x[0] for x in found if x) for found in best)
    new = tuple(tuple((x[0] - low, audits.index(x[1:3])) if x and x[0] - low <= HOPELESS else NONE for x in found) for found, low in zip(best, least, strict=True))
    return new, least, tuple(tuple(x and (x[3], x[2], x[4]) for x in found) for found in best)


def begin(state: int) -> tuple:
    """The vector in which only one state is open, with an empty audit."""
    return tuple((0, 0) if k == state else NONE for k in range(len(STATES)))


def end_state(now: tuple) -> int:
    """The state of the cheapest audit, with the inserts that its end needs."""
    return min(range(len(STATES)), key=lambda k: (now[k][0] + INSERT * len(LAST[STATES[k]]), now[k][1], len(LAST[STATES[k]])))


def swept(kinds: list[tuple[str, int]], now: tuple) -> tuple[tuple, list[int], list]:
    """What rows of (initial, fault) do to the vectors `now`, what each one's least is then, and each row's moves."""
    costs, moves = [0] * len(now), []
    for initial, fault in kinds:
        now, more, move = step(now, initial, fault)
        costs = [x + y for x, y in zip(costs, more, strict=True)]
        moves.append(move)
    return now, costs, moves


def traced(moves: list, state: int) -> list[tuple[str, str]]:
    """(letters, roles) of each row on the first vector's way that ends in `state`."""
    out = []
    for move in reversed(moves):
        state, letters, roles = move[0][state]
        out.append((letters, roles))
    return out[::-1]


def repaired(rows: list[tuple[str, str]], ways: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns that the ways of (role, text) give, without the last inserts."""
    out = []
    for (role, text), (_, roles) in zip(rows, ways, strict=True):
        for r in roles[:-1]:
            out.append(("I", NAMES[r], ""))
        if roles:
            out.append(("K", role, text) if roles[-1] == "-" else ("R", NAMES[roles[-1]], text))
    return out


def initial_of(role: str) -> str:
    """The initial of a role, `x` for all that no conversation may have."""
    return role[:1] if role[:1] in STATES else "x"


def sorted_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of `turns` (nulls: one space) and its fault, blank or truncated; `gone` rows only name their conversation."""
    text = F.coalesce(turns["text"].cast("string"), F.lit(" "))
    bare = F.btrim(text, F.lit(WHITE))
    fault = F.when(bare == "", BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(CUT)
    gone = turns["gone"] if "gone" in turns.columns else F.lit(False)
    return turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"].cast("string"), F.lit(" ")).alias("role"), text.alias("text"), fault.cast("int").alias("fault"), gone.alias("gone"))


class _Conversation:
    """The counts of one conversation, row after row."""

    def __init__(self):
        self.turns, self.low, self.high, self.counts, self.illegal, self.before, self.last = 0, None, None, [0, 0, 0, 0], 0, None, None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.high, self.last = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low
        self.counts[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode("utf-8", "surrogatepass")


def _solved(conv: int | None, rows: list[tuple]) -> dict:
    """The report and the turns of one conversation of sorted (turn, role, text, fault)."""
    seen, kinds, told = set(), [], _Conversation()
    for turn, role, text, fault in rows:
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        told.add(turn, initial_of(role), fault)
        kinds.append((initial_of(role), fault))
    (now,), (cost,), moves = swept(kinds, (begin(0),))
    last = end_state(now)
    ways = traced(moves, last)
    put = LAST[STATES[last]]
    out = repaired([r[1:3] for r in rows], ways) + [("I", NAMES[r], "") for r in put]
    digest = hashlib.sha256(b"\n".join(_line(r, t) for _, r, t in out)).hexdigest()
    audit = "".join(x for x, _ in ways) + "I" * len(put)
    return {"conv_id": conv, "gaps": told.gaps(), "blank": told.counts[BLANK], "duplicate": told.counts[DUPLICATE], "truncated": told.counts[CUT], "illegal": told.illegal, "cost": cost + now[last][0] + INSERT * len(put), "audit": audit, "repaired_sha256": digest, "turns": [dict(zip(("edit", "role", "text"), x, strict=True)) for x in out]}


_TURNS = "turns array<struct<edit: string, role: string, text: string>>"


def _short(turns: DataFrame) -> DataFrame:
    """The reports (and turns) of conversations of bounded size, one at a time from sorted rows."""
    schema = T.StructType.fromDDL(f"{REPORT}, {_TURNS}")
    arrow = pa.schema([(f.name, pa.list_(pa.struct([(x, pa.string()) for x in ("edit", "role", "text")])) if f.name == "turns" else pa.string() if f.dataType.typeName() == "string" else pa.int64()) for f in schema.fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, done, size = (False, None), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pylist(done, arrow)
            done.clear()

        for batch in batches:
            for conv, turn, role, text, fault, gone in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if (True, conv) != now:
                    if now[0]:
                        done.append(_solved(now[1], rows))
                    now, rows = (True, conv), []
                    if len(done) >= 256 or size > 8 << 20:
                        size = 0
                        yield from flush()
                if not gone:
                    rows.append((turn, role, text, fault))
                    size += len(text)
        if now[0]:
            done.append(_solved(now[1], rows))
        yield from flush()

    bounded_batches(turns.sparkSession)
    dealt = turns.select("conv_id", "turn", "role", "text", "fault", "gone").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(each, schema)


def _ranked(turns: DataFrame, work: str) -> DataFrame:
    """conv_id, block, at (within the order), turn, role, text, fault of the rows of long conversations, duplicates marked, written."""
    # rows that repeat a turn whole are one row with a count, so that no key of the join below is met by all of them
    once = turns.where("not gone").groupBy("conv_id", "turn", "role", "text", "fault").agg(F.count(F.lit(1)).alias("c"))
    once = once.withColumns({"h1": F.xxhash64("conv_id", "role", "text"), "h2": F.xxhash64(F.lit(1), "conv_id", "role", "text")})
    first = once.groupBy("h1", "h2").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))).alias("first"))
    met = once.join(first, ["h1", "h2"]).withColumn("k", F.explode(F.expr("sequence(1, cast(c as int))")))
    again = ~F.col("turn").eqNullSafe(F.col("first.turn")) | (F.col("k") > 1)
    fault = F.when(F.col("fault") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("fault"))
    faults = met.select("conv_id", "turn", "role", "text", "k", fault.cast("int").alias("fault"))
    keys = ("conv_id", "turn", "role", "text", "k")
    placed = faults.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.monotonically_increasing_id().alias("at"))
    return written(placed.select("conv_id", "turn", "role", "text", "fault", "at", F.floor(F.col("at") / LONG).alias("block")), f"{work}/placed")


def _chained(placed: DataFrame, work: str) -> DataFrame:
    """conv_id, block, start (the number of the state it starts in), last (its end on the cheapest way), cost and put, of each block."""

    def table_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        kinds = list(zip(map(initial_of, rows["initial"]), rows["fault"].tolist(), strict=True))
        ends, costs, _ = swept(kinds, tuple(begin(k) for k in range(len(STATES))))
        head = rows.iloc[0]
        flat = [(x[0] + low if x[0] < FAR else FAR, x[1]) for own, low in zip(ends, costs, strict=True) for x in own]
        return pd.DataFrame([{"conv_id": head.conv_id, "block": head["at"], "costs": [x[0] for x in flat], "ranks": [x[1] for x in flat]}])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        now, came, many = begin(0), [], range(len(STATES))
        for r in rows.itertuples():
            best = [min(((now[a][0] + r.costs[a * len(many) + b], (now[a][1], r.ranks[a * len(many) + b]), a) for a in many), default=None) for b in many]
            audits = sorted({x[1] for x in best})
            now = tuple((x[0], audits.index(x[1])) if x[0] < FAR else NONE for x in best)
            came.append([x[2] for x in best])
        state = end_state(now)
        put = LAST[STATES[state]]
        total, ways = now[state][0] + INSERT * len(put), []
        for found in reversed(came):
            ways.append((found[state], state))
            state = found[state]
        ways.reverse()
        return pd.DataFrame({"conv_id": rows["conv_id"], "block": rows["block"], "start": [x[0] for x in ways], "last": [x[1] for x in ways], "cost": total, "put": [""] * (len(rows) - 1) + [put]})

    kinds = placed.select(F.coalesce("conv_id", F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("none"), "block", "at", F.substring("role", 1, 1).alias("initial"), "fault")
    tables = kinds.groupBy("none", "conv_id", "block").applyInPandas(lambda k, x: table_of(x).assign(none=k[0]), "conv_id long, block long, costs array<long>, ranks array<int>, none boolean")
    return written(written(tables, f"{work}/tables").groupBy("none", "conv_id").applyInPandas(lambda k, x: chain(x).assign(none=k[0]), "conv_id long, block long, start int, last int, cost long, put string, none boolean"), f"{work}/chain")


def _long(turns: DataFrame, work: str) -> tuple[DataFrame, DataFrame]:
    """The reports of long conversations, and conv_id, at, k, edit, role, text of their repaired turns."""
    placed = _ranked(turns, work)
    chain = _chained(placed, work)

    def ways_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        kinds = list(zip(map(initial_of, rows["initial"]), rows["fault"].tolist(), strict=True))
        _, _, moves = swept(kinds, (begin(int(rows["start"].iloc[0])),))
        ways = traced(moves, int(rows["last"].iloc[0]))
        return pd.DataFrame({"at": rows["at"], "letters": [x for x, _ in ways], "roles": [x for _, x in ways]})

    first = placed.groupBy(F.col("conv_id").alias("id"), F.col("block").alias("cut")).agg(F.min("at").alias("lo"))
    blocks = written(first.join(chain.select(F.col("block").alias("lo"), "start", "last", "cost", "put"), "lo"), f"{work}/blocks")
    own = placed.select("conv_id", "block", "at", F.substring("role", 1, 1).alias("initial"), "fault")
    own = own.join(blocks, (F.col("block") == F.col("cut")) & F.col("conv_id").eqNullSafe(F.col("id"))).select("lo", "start", "last", "at", "initial", "fault")
    ways = written(own.groupBy("lo").applyInPandas(ways_of, "at long, letters string, roles string"), f"{work}/ways")
    rows = placed.join(ways, "at")
    last = blocks.where("put != ''").select(F.col("id").alias("conv_id"), "put")
    inserted = F.expr("transform(filter(split(roles, ''), (x, i) -> i < length(roles) - 1), x -> struct('I' as edit, if(x = 'u', 'user', 'assistant') as role, '' as text))")
    itself = F.expr("if(roles = '', array(), array(if(right(roles, 1) = '-', struct('K' as edit, role, text), struct('R' as edit, if(right(roles, 1) = 'u', 'user', 'assistant') as role, text))))")
    out = rows.select("conv_id", "at", F.posexplode(F.concat(inserted, itself)).alias("k", "x")).select("conv_id", "at", "k", "x.*")
    tail = last.select("conv_id", F.lit(1 << 62).alias("at"), F.posexplode(F.expr("transform(split(put, ''), x -> if(x = 'u', 'user', 'assistant'))")).alias("k", "role")).select("conv_id", "at", "k", F.lit("I").alias("edit"), "role", F.lit("").alias("text"))
    out = written(out.unionByName(tail), f"{work}/turns")

    names = ("gaps", "blank", "duplicate", "truncated", "illegal")
    report_of = lambda conv, x, audit: pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), *[pa.array([v]) for v in (x.gaps(), *x.counts[1:], x.illegal)], pa.array(["".join(audit)])], names=["conv_id", *names, "letters"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One report for each conversation, from its rows in order: counts, and letters as they come."""
        now, counts, audit = (False, None), _Conversation(), []
        for batch in batches:
            for conv, turn, initial, fault, letters in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if (True, conv) != now:
                    if now[0]:
                        yield report_of(now[1], counts, audit)
                    now, counts, audit = (True, conv), _Conversation(), []
                counts.add(turn, initial, fault)
                audit.append(letters)
        if now[0]:
            yield report_of(now[1], counts, audit)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, found = (False, None), hashlib.sha256(), []
        for batch in batches:
            for conv, role, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if (True, conv) != now:
                    found += [(now[1], h.hexdigest())] if now[0] else []
                    now, h = (True, conv), hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(_line(role, text))
        found += [(now[1], h.hexdigest())] if now[0] else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], names=["id", "repaired_sha256"])

    bounded_batches(turns.sparkSession)
    counts = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "letters", "at").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    counts = counts.drop("at").mapInArrow(told, f"conv_id long, {', '.join(f'{x} long' for x in names)}, letters string")
    hashed = out.select("conv_id", "role", "text", "at", "k").repartition("conv_id").sortWithinPartitions("conv_id", "at", "k").select("conv_id", "role", "text").mapInArrow(digests, "id long, repaired_sha256 string")
    costs = blocks.groupBy(F.col("id").alias("of")).agg(F.first("cost").alias("cost"), F.max("put").alias("put"))
    report = counts.join(costs, F.col("conv_id").eqNullSafe(F.col("of"))).join(hashed, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    audit = F.concat("letters", F.regexp_replace("put", ".", "I"))
    return report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), out


def repair(turns: DataFrame, work: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(reports, turns): REPORT's columns for each conversation, and conv_id, at, k (their order), edit, role, text of each repaired turn.

    `turns` has conv_id, turn, role, text, and may have `gone`, which marks rows that only name their conversation.
    """
    work = work or work_dir(turns.sparkSession, "repair")
    rows = sorted_turns(turns)
    sizes = rows.where("not gone").groupBy("conv_id").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("text")).alias("bytes"))
    long = written(sizes.where((F.col("c") > LONG) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv_id").alias("id")), f"{work}/long")
    same = rows["conv_id"].eqNullSafe(long["id"])
    some = not long.isEmpty()
    short = _short(rows.join(long, same, "left_anti") if some else rows)
    found = short.select("conv_id", F.posexplode("turns").alias("at", "x")).select("conv_id", F.col("at").cast("long").alias("at"), F.lit(0).alias("k"), "x.*")
    if not some:
        return short.drop("turns"), found
    reports, more = _long(rows.join(long, same, "left_semi"), work)
    return short.drop("turns").unionByName(reports), found.unionByName(more)


def damaged(turns: DataFrame) -> DataFrame:
    """`turns` with faults made on purpose, by the crc32 of conv_id and turn modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    stops, 3 repeats it, 4 makes its role user. Dropped rows stay as `gone`."""
    text = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), (kind == 0).alias("gone"), kind)
    return out.withColumn("copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "kind")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of all conversations, damaged and repaired."""
    return repair(damaged(table(spark, sf_dir, "conversations")))[0]
