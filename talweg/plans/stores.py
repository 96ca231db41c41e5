"""Sources, sinks and listings over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.operators import store
from talweg.plans.registry import query
from talweg.sources.tables import table

_C = F.col
DOC_COLUMNS = "doc_id, lang, source, n_chars"


@query("src_01_full_scan", f"SELECT {DOC_COLUMNS} FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("src_02_point_lookup", f"SELECT {DOC_COLUMNS} FROM documents WHERE doc_id = 17")
def _(spark, d):
    return store.point_lookup(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id", 17)


@query("src_03_lookup_ignoring_case", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE lower(c_name) = 'customer#000000042'")
def _(spark, d):
    return store.lookup_ignoring_case(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_name", "CUSTOMER#000000042")


@query("src_04_exists", "SELECT count(*) > 0 AS found FROM (SELECT 1 FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F' LIMIT 1)")
def _(spark, d):
    return store.exists(table(spark, d, "orders"), (_C("o_custkey") == 7) & (_C("o_orderstatus") == "F"))


@query("src_05_latest_by_hash", "SELECT sha256(text) AS hash, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(spark, d):
    hashed = table(spark, d, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id")
    return store.latest_by(hashed, ["hash"], [F.desc("doc_id")])


@query("src_06_json_listing", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events")
def _(spark, d):
    """Scalars out of a JSON column, with defaults; the document itself isn't moved on."""
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "int"), F.lit(-1)).alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "string"), F.lit("")).alias("missing"))


@query("src_07_newest_listing", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def _(spark, d):
    return store.newest(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 200, ["o_totalprice"])


_NEW = "SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_orderdate + INTERVAL 30 DAY AS o_orderdate FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 11 = 0"


def _orders(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    changed = old.where("o_orderkey % 7 = 0").select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"), (_C("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("o_orderdate"))
    return old, changed.union(old.where("o_orderkey % 11 = 0").withColumn("o_orderkey", _C("o_orderkey") + 1_000_000_000))


@query(
    "snk_01_upsert",
    f"""WITH n AS ({_NEW}) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN o.o_custkey ELSE n.o_custkey END AS o_custkey,
    CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus, coalesce(o.o_orderdate, n.o_orderdate) AS o_orderdate FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey""",
)
def _(spark, d):
    """Upsert by key; o_orderdate plays the creation time, which stays."""
    return store.upsert(*_orders(spark, d), "o_orderkey", "o_orderdate")


@query("snk_02_insert_absent", f"WITH n AS ({_NEW}) SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders UNION ALL SELECT * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(spark, d):
    return store.insert_absent(*_orders(spark, d), "o_orderkey")


@query(
    "snk_03_mirror_plan",
    f"""WITH n AS ({_NEW}) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'delete' WHEN o.o_orderkey IS NULL THEN 'insert'
    WHEN (o.o_custkey, o.o_orderstatus, o.o_orderdate) <> (n.o_custkey, n.o_orderstatus, n.o_orderdate) THEN 'update' ELSE 'keep' END AS action FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey""",
)
def _(spark, d):
    return store.mirror_plan(*_orders(spark, d), "o_orderkey")


@query(
    "snk_04_replace_partition",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0) UNION ALL SELECT o_custkey, o_orderkey, 0.0 FROM orders WHERE o_orderkey % 5 = 0",
)
def _(spark, d):
    """All results of a customer go when new ones come."""
    old = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return store.replace_partition(old, old.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.lit(0.0)), "o_custkey")


@query("snk_05_partial_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 12.5 ELSE o_totalprice END AS o_totalprice, o_custkey FROM orders")
def _(spark, d):
    """Of three changes the two allowed ones are made, the text cast to the column's type."""
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    return store.patch(df, _C("o_orderkey") % 3 == 0, {"o_orderstatus": F.lit("C"), "o_totalprice": F.lit("12.5"), "o_custkey": F.lit(0)}, ["o_orderstatus", "o_totalprice"])


@query("snk_06_insert_and_flags", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'signed' ELSE 'open' END AS state FROM orders UNION ALL SELECT -1 - o_orderkey, 'imported' FROM orders WHERE o_orderkey < 50")
def _(spark, d):
    df = table(spark, d, "orders")
    flagged = df.select("o_orderkey", F.when(_C("o_orderstatus") == "F", "signed").otherwise("open").alias("state"))
    return flagged.union(df.where("o_orderkey < 50").select((-1 - _C("o_orderkey")), F.lit("imported")))


_AT = "timestamp '2001-08-02 00:00:00'"


@query(
    "snk_07_soft_delete",
    f"SELECT 'kept' AS place, o_orderkey, NULL::TIMESTAMP AS deleted_at FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT 'bin', o_orderkey, {_AT} FROM orders WHERE o_orderkey % 9 = 0",
)
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    kept, gone = store.soft_delete(df, _C("o_orderkey") % 9 == 0, "order", F.lit("2001-08-02 00:00:00").cast("timestamp_ntz"))
    binned = gone.select(F.lit("bin").alias("place"), F.get_json_object("payload", "$.o_orderkey").cast("long").alias("o_orderkey"), "deleted_at")
    return kept.select(F.lit("kept").alias("place"), "o_orderkey", F.lit(None).cast("timestamp_ntz").alias("deleted_at")).union(binned)


@query("snk_08_restore", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def _(spark, d):
    """What was soft-deleted comes back: the table is as it was."""
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return store.restore(*store.soft_delete(df, _C("o_orderkey") % 9 == 0, "order", F.lit("2001-08-02").cast("date")), "order")


@query("snk_09_idempotent_ids", "SELECT DISTINCT sha256(coalesce(length(event_type) || ':' || event_type, '-') || coalesce(length(user_id::VARCHAR) || ':' || user_id::VARCHAR, '-')) AS content_id, event_type, user_id FROM events")
def _(spark, d):
    twice = table(spark, d, "events").select("event_type", "user_id")
    return store.with_content_id(twice.union(twice), ["user_id", "event_type"])


@query("snk_10_reconcile", "SELECT 'orders' AS name, count(*) AS n_rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer")
def _(spark, d):
    return store.reconcile(**{t: table(spark, d, t) for t in ("orders", "lineitem", "customer")})


@query("snk_11_hard_delete", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)")
def _(spark, d):
    return store.delete(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), _C("o_orderstatus") == "F").select("o_orderkey")


@query("snk_12_append_event", "SELECT event_id, event_type FROM events UNION ALL SELECT max(event_id) + 1, 'match_run' FROM events")
def _(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type")
    return df.union(df.agg((F.max("event_id") + 1).alias("event_id")).withColumn("event_type", F.lit("match_run")))


@query("snk_14_revision_check", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = o_custkey % 4 THEN 'saved' ELSE 'conflict' END AS outcome, CASE WHEN o_orderkey % 4 = o_custkey % 4 THEN o_orderkey % 4 + 1 ELSE o_orderkey % 4 END AS rev FROM orders")
def _(spark, d):
    """A save counts only if the revision it was made from is the stored one."""
    df = table(spark, d, "orders").select("o_orderkey", (_C("o_orderkey") % 4).alias("rev"), (_C("o_custkey") % 4).alias("base_rev"))
    same = _C("rev") == _C("base_rev")
    return df.select("o_orderkey", F.when(same, "saved").otherwise("conflict").alias("outcome"), F.when(same, _C("rev") + 1).otherwise(_C("rev")).alias("rev"))
