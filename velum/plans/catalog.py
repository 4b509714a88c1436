"""The registered queries: each applies an operator to the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.functions import columns as fn
from velum.operators import auth, bloom, graph, merge, stats
from velum.operators.query import Query

from velum.plans.relations import Tables, with_relations
from velum.sources import log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
col, lit = F.col, F.lit


def query(sql: str | None = None, *relations: str, recursive: bool = False, name: str | None = None):
    """Register a function of Tables under its name."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = with_relations(sql, *relations, recursive=recursive)
        return f

    return add



#: A 32-bit number of a value and a seed, as ``fn.number_of``.
_MD5 = "CAST('0x' || substr(md5('{seed}/' || {x}), 1, 8) AS BIGINT)"


# --- Scans and sinks ---------------------------------------------------------------


@query("SELECT id, key, ts, parent FROM c", "c")
def scan_full(t):
    return t.c.select("id", "key", "ts", "parent")


@query("SELECT event_id AS id, value FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 1")
def append_dedup(t):
    e = t.events.select(col("event_id").alias("id"), "value")
    return log.append_new(e.filter("id % 2 = 0"), e.filter("id % 3 = 0").union(e.filter("id % 9 = 0")))


@query("SELECT DISTINCT user_id AS key FROM events")
def keys_scan(t):
    return t.c.select("key").distinct()


@query("SELECT DISTINCT '/data/events/' || user_id AS path FROM events")
def paths_scan(t):
    return t.c.select(fn.item_path(lit("data"), lit("events"), col("key").cast("string")).alias("path")).distinct()


@query("SELECT id, key, session FROM c WHERE session <> 'error'", "c")
def commits_scan(t):
    return t.c.filter("session <> 'error'").select("id", "key", "session")


@query("SELECT id, ts FROM c WHERE key = 1 ORDER BY ts DESC, id DESC", "c")
def commits_for_key_desc(t):
    return t.c.filter("key = 1").select("id", "ts").orderBy(*graph.newest_first())


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def repo_key_count(t):
    return t.events.agg(F.countDistinct("user_id").alias("n"))


@query("SELECT count(*) AS n FROM events")
def repo_commit_count(t):
    return t.events.agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, user_id AS key, value FROM events WHERE event_id = 42")
def commit_by_id(t):
    return t.events.filter("event_id = 42").select(col("event_id").alias("id"), col("user_id").alias("key"), "value")


@query("SELECT path, o_totalprice FROM i WHERE path = '/data/orders/7'", "i")
def item_by_path(t):
    return t.i.filter("path = '/data/orders/7'").select("path", "o_totalprice")


@query("SELECT event_id AS id, event_type AS ns FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 1 AND event_type IN ('click', 'view', 'purchase')")
def ingest_dedup(t):
    e = t.events.select(col("event_id").alias("id"), col("event_type").alias("ns"))
    return log.ingest(e.filter("id % 2 = 0"), e.filter("id % 3 = 0").union(e.filter("id % 9 = 0")), ["click", "view", "purchase"])


@query("SELECT key, max(age) AS age FROM c GROUP BY key", "c")
def age_for_key(t):
    return t.aged.groupBy("key").agg(F.max("age").alias("age"))


@query(f"SELECT event_id, event_type FROM events WHERE {_MD5.format(x='event_id', seed=7)} % 10 = 0")
def log_sample(t):
    return log.sample(t.events, "event_id", 10, seed=7).select("event_id", "event_type")


@query("SELECT event_id, CAST(event_id % 6 AS BIGINT) AS severity FROM events WHERE event_id % 6 >= 4")
def log_severity_filter(t):
    return t.events.select("event_id", (col("event_id") % 6).alias("severity")).filter("severity >= 4")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def logs_sql(t):
    return log.readonly_sql(t.spark, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM {e} GROUP BY event_type", e=t.events)


# --- Filters and projections -----------------------------------------------------------


@query("SELECT path, o_totalprice FROM i WHERE NOT is_deleted AND o_totalprice > 200000", "i")
def filter_gt(t):
    return Query(t.i, col("o_totalprice") > 200000).results().select("path", "o_totalprice")


@query("SELECT path, ns FROM i WHERE NOT is_deleted AND ns = '1-URGENT'", "i")
def filter_namespace(t):
    return Query(t.i, schema="1-URGENT").results().select("path", "ns")


@query("SELECT path FROM i WHERE NOT is_deleted", "i")
def filter_not_deleted(t):
    return Query(t.i).paths()


@query("SELECT path, o_totalprice FROM i WHERE NOT is_deleted AND o_totalprice BETWEEN 50000 AND 90000", "i")
def filter_ctx_param(t):
    return Query(t.i, lambda ctx: col("o_totalprice").between(ctx["low"], ctx["high"]), ctx={"low": 50000, "high": 90000}).results().select("path", "o_totalprice")


@query("SELECT path, o_totalprice FROM i WHERE NOT is_deleted AND o_totalprice > 100000 AND o_totalprice < 150000 AND o_orderstatus IN ('O', 'P') ORDER BY o_totalprice DESC NULLS LAST, age, path", "i")
def filter_complex_sort(t):
    return Query(t.i, (col("o_totalprice") > 100000) & (col("o_totalprice") < 150000) & col("o_orderstatus").isin("O", "P"), sort_by="o_totalprice", descending=True).results().select("path", "o_totalprice")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM d", "d")
def project_default(t):
    return t.d.select("doc_id", F.coalesce("quality", lit(-1)).alias("quality"))


@query("SELECT doc_id FROM d WHERE quality IS NOT NULL", "d")
def filter_has_field(t):
    return t.d.filter(col("quality").isNotNull()).select("doc_id")


@query("SELECT path, o_custkey, o_orderdate FROM i", "i")
def project_subset(t):
    return t.i.select("path", "o_custkey", "o_orderdate")


@query("SELECT path, o_custkey AS item_custkey, o_totalprice AS item_price FROM i WHERE NOT is_deleted AND ns = '5-LOW'", "i")
def query_entries(t):
    return Query(t.i, schema="5-LOW").entries().select("path", col("item.o_custkey").alias("item_custkey"), col("item.o_totalprice").alias("item_price"))


@query("SELECT '/data/orders/' || o_orderkey AS path, o_orderstatus <> 'F' AND o_totalprice > 100000 AS has FROM orders")
def query_has(t):
    return Query(t.i, col("o_totalprice") > 100000).has(t.i.select("path"))


@query("SELECT path, o_custkey FROM i WHERE NOT is_deleted AND o_custkey = (SELECT min(o_custkey) FROM i WHERE NOT is_deleted) ORDER BY age, path LIMIT 1", "i")
def find_by_sort_field(t):
    least = Query(t.i).matches().agg(F.min("o_custkey")).first()[0]
    return Query(t.i, sort_by="o_custkey").find("o_custkey", least).select("path", "o_custkey")


@query("SELECT path, o_orderstatus FROM i WHERE NOT is_deleted AND o_orderstatus = 'O' ORDER BY o_totalprice NULLS FIRST, age, path LIMIT 1", "i")
def find_by_other_field(t):
    return Query(t.i, sort_by="o_totalprice").find("o_orderstatus", "O").select("path", "o_orderstatus")


_REPO = "CASE c_custkey % 6 WHEN 0 THEN '/sys/sessions' WHEN 1 THEN '/sys/stats' WHEN 2 THEN '/sys/keys' WHEN 3 THEN '/user/' || c_nationkey WHEN 4 THEN '/data/open' ELSE '/data/' || c_nationkey END"


def _repos(t):
    return t.customer.select("c_custkey", "c_nationkey", F.expr(_REPO).alias("repo"))


@query(f"SELECT c_custkey, repo FROM (SELECT c_custkey, c_nationkey, {_REPO} AS repo FROM customer) WHERE repo IN ('/sys/sessions', '/user/7', '/data/open') OR (repo LIKE '/data/%' AND c_nationkey < 5)")
def auth_rules(t):
    """What user 7 may read: built-in rules, an exact path and a pattern with a rule on rows."""
    rules = auth.AuthRules().register("/data/open", lambda user: lit(True)).register(re.compile("^/data/.*$"), lambda user: col("c_nationkey") < 5)
    return _repos(t).filter(rules.readable(col("repo"), user="7")).select("c_custkey", "repo")


@query(f"SELECT c_custkey, {_REPO} AS repo FROM customer WHERE c_custkey % 6 <= 2")
def auth_root(t):
    """The root user reads all system repositories, and nothing that has no rule."""
    repos = _repos(t)
    return repos.filter(col("repo").startswith("/sys/") & auth.AuthRules().readable(col("repo"), user="root", root="root")).select("c_custkey", "repo")


@query("SELECT event_id FROM events WHERE event_id % 4 = 0 OR event_id % 4 = 2")
def org_filter(t):
    e = t.events.select("event_id", F.when(col("event_id") % 4 != 0, F.concat(lit("org"), (col("event_id") % 4).cast("string"))).alias("org"))
    return e.filter(auth.of_org(col("org"), "org2")).select("event_id")


@query("SELECT c_custkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 OR c_custkey % 50 = 0")
def auth_row_filter(t):
    allowed = t.nation.filter("n_regionkey = 1").select(col("n_nationkey").alias("c_nationkey"), lit(True).alias("rule"))
    return t.customer.join(allowed, "c_nationkey", "left").filter(F.coalesce("rule", lit(False)) | (col("c_custkey") % 50 == 0)).select("c_custkey", "c_nationkey")


@query("SELECT path, ns FROM i WHERE ns IN ('1-URGENT', '2-HIGH')", "i")
def ns_allowlist(t):
    return t.i.filter(col("ns").isin("1-URGENT", "2-HIGH")).select("path", "ns")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'client' WHEN event_type IN ('purchase', 'signup') THEN 'server' ELSE 'other' END AS class FROM events")
def metric_classify(t):
    kind = F.when(col("event_type").isin("click", "view"), "client").when(col("event_type").isin("purchase", "signup"), "server").otherwise("other")
    return t.events.select("event_id", kind.alias("class"))


# --- Joins -----------------------------------------------------------------------------


@query("SELECT id, key FROM lv", "lv")
def leaves_anti_join(t):
    return graph.leaves(t.c).select("id", "key")


@query("SELECT c.id, c.parent AS base_id, round(c.value - b.value, 6) AS delta FROM c JOIN c b ON c.parent = b.id", "c")
def delta_base_join(t):
    return graph.with_parent(t.c, ["value"]).select("id", col("parent").alias("base_id"), F.round(col("value") - col("parent_value"), 6).alias("delta"))


@query(
    """SELECT c.id, concat_ws(',', CASE WHEN c.connection <> p.connection THEN 'connection' END, CASE WHEN c.session <> p.session THEN 'session' END, CASE WHEN c.value <> p.value THEN 'value' END) AS changed
    FROM c JOIN c p ON c.parent = p.id""",
    "c",
)
def parent_join_changed_fields(t):
    names = merge.changed_names({n: (col(n), col(f"parent_{n}")) for n in ("connection", "session", "value")})
    return graph.with_parent(t.c, ["connection", "session", "value"]).select("id", F.array_join(names, ",").alias("changed"))


@query("SELECT parent AS id, count(*) AS children, max(id) AS newest FROM c WHERE parent IS NOT NULL GROUP BY parent", "c")
def children_join(t):
    return graph.edges(t.c).groupBy(col("parent").alias("id")).agg(F.count("*").alias("children"), F.max("child").alias("newest"))


_PAIRS = """ranked AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS r FROM lv),
    pairs AS (SELECT x.key, x.id AS a, y.id AS b FROM ranked x JOIN ranked y ON x.key = y.key AND x.r = 1 AND y.r = 2)"""


@query(
    f"""WITH {_PAIRS}, st AS (SELECT a AS id FROM pairs UNION SELECT b FROM pairs),
    up(start, id) AS (SELECT id, id FROM st UNION ALL SELECT up.start, c.parent FROM up JOIN c ON up.id = c.id WHERE c.parent IS NOT NULL)
    SELECT p.key, p.a, p.b, arg_max(c.id, (c.ts, c.id)) AS base FROM pairs p JOIN up x ON x.start = p.a JOIN up y ON y.start = p.b AND y.id = x.id JOIN c ON c.id = x.id GROUP BY ALL""",
    "lv",
    recursive=True,
)
def lca(t):
    ranked = graph.leaves(t.c).withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(*graph.newest_first())))
    pairs = ranked.filter("r <= 2").groupBy("key").agg(F.max(F.when(col("r") == 1, col("id"))).alias("a"), F.max(F.when(col("r") == 2, col("id"))).alias("b")).filter("b is not null")
    return graph.common_ancestor(t.spark, t.c, pairs)


@query("SELECT key, id AS child, parent FROM c WHERE id % 7 <> 0 AND parent % 7 = 0", "c")
def missing_parents(t):
    return graph.missing_parents(t.c.filter("id % 7 <> 0")).select("key", "child", "parent")


@query("SELECT path FROM i WHERE NOT is_deleted AND o_totalprice > 100000 AND o_custkey % 2 = 0", "i")
def chained_query(t):
    return Query(Query(t.i, col("o_totalprice") > 100000), col("o_custkey") % 2 == 0).paths()


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def session_join(t):
    return t.orders.join(t.customer, col("o_custkey") == col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("SELECT key, arg_max(id, (ts, id)) AS id FROM c WHERE session = 'view' AND ts < TIMESTAMP '2024-01-15' GROUP BY key", "c")
def asof_commit_before(t):
    return graph.latest(t.c.filter("session = 'view' AND ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("key", "id")


@query("SELECT h.key, h.id, arg_max(c.id, (c.ts, c.id)) AS found FROM (SELECT key, arg_max(id, (ts, id)) AS id, max(ts) AS ts FROM c GROUP BY key) h JOIN c ON c.key = h.key AND c.ts < h.ts AND c.value > 50 GROUP BY h.key, h.id", "c")
def asof_latest_ancestor(t):
    newest = graph.latest(t.c).select("key", col("id").alias("head"), col("ts").alias("head_ts"))
    older = t.c.join(newest, "key").filter("ts < head_ts AND value > 50")
    return older.groupBy("key", col("head").alias("id")).agg(F.max_by("id", F.struct("ts", "id")).alias("found"))


@query("SELECT event_id AS id FROM events WHERE event_id % 3 <> 0 AND event_id % 3 = 1")
def sync_missing(t):
    e = t.events.select(col("event_id").alias("id"))
    return e.filter("id % 3 <> 0").join(e.filter("id % 3 <> 1"), "id", "left_anti")


@query("SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_custkey) AS users FROM events JOIN customer ON user_id = c_custkey WHERE c_custkey % 10 <> 0 GROUP BY c_mktsegment")
def stats_users_events(t):
    operators = t.customer.filter("c_custkey % 10 = 0").select("c_custkey")
    users = t.customer.join(operators, "c_custkey", "left_anti")
    return t.events.join(users, col("user_id") == col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("users"))


@query("SELECT md5(text) AS checksum, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def unique_items(t):
    return t.documents.groupBy(F.md5("text").alias("checksum")).agg(F.min("doc_id").alias("doc_id"))


# --- Aggregations ----------------------------------------------------------------------


@query("SELECT count(*) AS n FROM i WHERE NOT is_deleted AND o_totalprice > 150000", "i")
def query_count(t):
    return Query(t.i, col("o_totalprice") > 150000, limit=5).count()


@query("SELECT key, arg_max(id, (ts, id)) AS id FROM c WHERE session = 'purchase' GROUP BY key", "c")
def latest_full_commit(t):
    return graph.latest(t.c.filter("session = 'purchase'")).select("key", "id")


@query("SELECT connection, id FROM (SELECT connection, id, row_number() OVER (PARTITION BY connection ORDER BY ts DESC, id) AS n FROM c) WHERE n = 1", "c")
def latest_per_connection(t):
    return t.c.groupBy("connection").agg(F.max_by("id", F.struct(col("ts"), -col("id"))).alias("id"))


@query("""SELECT count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-30' THEN user_id END) AS dau, count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-24' THEN user_id END) AS wau,
    count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-01' THEN user_id END) AS mau, count(*) AS scanned FROM events""")
def dau_wau_mau(t):
    def since(day):
        return F.countDistinct(F.when(col("ts") >= F.expr(f"TIMESTAMP_NTZ '{day} 00:00:00'"), col("user_id")))

    return t.events.agg(since("2024-01-30").alias("dau"), since("2024-01-24").alias("wau"), since("2024-01-01").alias("mau"), F.count("*").alias("scanned"))


@query("SELECT l_returnflag, round(coalesce(avg(CASE WHEN l_quantity > 49 THEN l_extendedprice END), 0), 4) AS mean FROM lineitem GROUP BY l_returnflag")
def avg_zero_default(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.coalesce(F.avg(F.when(col("l_quantity") > 49, col("l_extendedprice"))), lit(0.0)), 4).alias("mean"))


@query("""SELECT l_shipmode_ AS suite, round(avg(x), 4) AS mean, min(x) AS least, max(x) AS most, round(stddev_pop(x), 4) AS sd, list_sort(list(x))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95,
    list_sort(list(x))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] AS p99, round(1000 / avg(x), 6) AS throughput, count(*) AS n FROM (SELECT l_suppkey AS l_shipmode_, l_extendedprice AS x FROM lineitem) GROUP BY 1""")
def latency_stats(t):
    return stats.latency(t.lineitem, "l_suppkey", "l_extendedprice", "suite")


@query("SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 6) AS per_unit, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def partial_final_avg(t):
    part = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_extendedprice").alias("s"), F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return part.groupBy("l_returnflag").agg(F.round(F.sum("s") / F.sum("q"), 6).alias("per_unit"), F.sum("n").alias("n"))


@query("SELECT l_linestatus AS suite, CAST(sum(CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS failed, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def suite_rollup(t):
    ok = col("l_discount") < 0.05
    return t.lineitem.groupBy(col("l_linestatus").alias("suite")).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("SELECT l_orderkey AS task, round(CASE WHEN bool_or(l_tax = 0) THEN CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) WHEN sum(l_quantity) = 0 THEN 1.0 ELSE sum(l_quantity * l_discount) / sum(l_quantity) END, 9) AS progress FROM lineitem GROUP BY 1")
def weighted_progress(t):
    unknown = F.bool_or(col("l_tax") == 0)
    share = F.when(unknown, F.count_if(col("l_quantity") > 25) / F.count("*")).when(F.sum("l_quantity") == 0, 1.0).otherwise(F.sum(col("l_quantity") * col("l_discount")) / F.sum("l_quantity"))
    return t.lineitem.groupBy(col("l_orderkey").alias("task")).agg(F.round(share, 9).alias("progress"))


_LWW = "CASE WHEN {x}2 IS NOT NULL AND {x}2 IS DISTINCT FROM {x}0 THEN {x}2 WHEN {x}1 IS NOT NULL AND {x}1 IS DISTINCT FROM {x}0 THEN {x}1 WHEN {x}1 IS NOT NULL AND {x}2 IS NOT NULL THEN {x}0 END"


@query(f"SELECT key, {_LWW.format(x='p')} AS price, {_LWW.format(x='s')} AS priority, {_LWW.format(x='u')} AS status FROM t", "t")
def merge_lww(t):
    m = {n: merge.merge_value(*[col(f"{x}{k}") for k in range(3)]).alias(n) for n, x in (("price", "p"), ("priority", "s"), ("status", "u"))}
    return t.t.select("key", *m.values())


@query("SELECT id, list_sort(list_filter(list_distinct(list_concat(list_concat(base, a), b)), lambda x: NOT ((list_contains(base, x) AND NOT list_contains(a, x)) OR (list_contains(base, x) AND NOT list_contains(b, x))))) AS merged FROM k", "k")
def merge_set(t):
    return t.k.select("id", merge.merge_sets(col("base"), col("a"), col("b")).alias("merged"))


@query(
    """WITH h AS (SELECT event_id FROM events WHERE event_id % 3 <> 0), s AS (SELECT CAST(ceil(count(*) * ln(0.01) / ln(1 / pow(2, ln(2)))) AS BIGINT) AS bits FROM h),
    p AS (SELECT DISTINCT CAST('0x' || substr(md5((k // 4) || '/' || event_id), (k % 4) * 8 + 1, 8) AS BIGINT) % bits AS b, bits FROM h, s, range(7) r(k)) SELECT count(*) / max(bits) AS fill_rate FROM p"""
)
def bloom_fill(t):
    held = t.events.filter("event_id % 3 <> 0")
    bits, hashes = bloom.sizes(max(1, held.count()), 0.01)
    return bloom.fill_rate(bloom.fill(held, "event_id", bits, hashes), bits)


_FIELD = "coalesce('{n}:' || length(CAST({n} AS VARCHAR)) || ':' || {n} || ';', '{n};')"


@query(f"SELECT doc_id, md5({' || '.join(_FIELD.format(n=n) for n in ('lang', 'n_chars', 'source', 'text'))}) AS checksum FROM documents")
def doc_checksum(t):
    return t.documents.select("doc_id", fn.checksum({n: col(n) for n in ("text", "source", "lang", "n_chars")}).alias("checksum"))


@query("SELECT doc_id, md5(text) AS checksum FROM documents")
def doc_md5(t):
    return t.documents.select("doc_id", F.md5("text").alias("checksum"))


@query("SELECT l_orderkey AS id, count(l_partkey) > count(DISTINCT l_partkey) AS duplicates FROM lineitem GROUP BY 1")
def has_duplicates(t):
    return t.lineitem.groupBy(col("l_orderkey").alias("id")).agg((F.count("l_partkey") > F.countDistinct("l_partkey")).alias("duplicates"))


@query("SELECT event_type AS name, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1")
def metric_by_status(t):
    return t.events.groupBy(col("event_type").alias("name")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query("SELECT round(avg(value), 6) AS mean, round(100.0 * sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) / count(*), 6) AS success FROM events")
def success_rate(t):
    return t.events.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(100.0 * F.count_if(col("event_type") != "error") / F.count("*"), 6).alias("success"))


@query("SELECT id, CASE WHEN len(list_filter(a, lambda x: x < 100)) = len(a) THEN -1 ELSE len(list_filter(a, lambda x: x < 100)) END::INT AS at, a[1] AS some, CAST(len(a) AS INT) AS n FROM k", "k")
def array_bsearch(t):
    return t.k.select("id", fn.insertion_point(col("a"), lit(100)).alias("at"), F.try_element_at("a", lit(1)).alias("some"), F.size("a").alias("n"))


@query("SELECT DISTINCT user_id AS key, event_type AS session FROM events")
def distinct_keys(t):
    return t.c.select("key", "session").distinct()


# --- Windows -----------------------------------------------------------------------------


@query("SELECT key, arg_max(id, (ts, id)) AS id FROM lv GROUP BY key", "lv")
def head_per_key(t):
    return graph.heads(t.c).select("key", "id")


@query("SELECT key, id FROM (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN session = 'view' THEN 0 ELSE 1 END, ts DESC, id DESC) AS n FROM lv) WHERE n = 1", "lv")
def head_per_key_preferring_session(t):
    return graph.heads(t.c, F.when(col("session") == "view", 0).otherwise(1)).select("key", "id")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def moving_average(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return t.events.select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@query("SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def prev_version_lag(t):
    return t.events.select("event_id", F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) / 3) AS BIGINT) AS slice FROM conversations")
def batch_slices(t):
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return t.conversations.select("conv_id", "turn", F.floor((n - 1) / 3).alias("slice"))


@query("SELECT key, count(DISTINCT parent) AS n FROM c GROUP BY key", "c")
def ancestors_count(t):
    return t.c.groupBy("key").agg(F.countDistinct("parent").alias("n"))


# --- Order and limit ---------------------------------------------------------------------


def _sorted(name, descending, limit):
    way = "DESC NULLS LAST" if descending else "ASC NULLS FIRST"

    @query(f"SELECT path, o_totalprice FROM i WHERE NOT is_deleted ORDER BY o_totalprice {way}, age, path{f' LIMIT {limit}' if limit else ''}", "i", name=name)
    def run(t):
        return Query(t.i, sort_by="o_totalprice", descending=descending, limit=limit).results().select("path", "o_totalprice")


_sorted("sort_by_field", False, 0)
_sorted("sort_by_field_desc", True, 0)
_sorted("top_k", True, 10)


@query("SELECT path, o_custkey, o_totalprice FROM i WHERE NOT is_deleted ORDER BY o_custkey, o_totalprice, age LIMIT 100", "i")
def sort_multi_key(t):
    return Query(t.i, sort_by=["o_custkey", "o_totalprice"], limit=100).results().select("path", "o_custkey", "o_totalprice")


@query("SELECT path FROM i WHERE NOT is_deleted ORDER BY age LIMIT 25", "i")
def limit_insertion_order(t):
    return Query(t.i, limit=25).paths()


@query("SELECT key, arg_min(peer, (md5(peer || '/' || key), peer)) AS leader FROM (SELECT DISTINCT user_id AS key, CAST(event_id % 4 AS VARCHAR) AS peer FROM events) GROUP BY key")
def rendezvous_leader(t):
    peers = t.c.select("key", col("connection").cast("string").alias("peer")).distinct()
    return peers.groupBy("key").agg(fn.rendezvous(col("peer"), col("key")).alias("leader"))


@query("""SELECT key, arg_min(peer, (md5(peer || '/' || key), peer)) AS leader FROM (SELECT key, CAST(connection AS VARCHAR) AS peer FROM (SELECT *, max(ts) OVER (PARTITION BY key) AS newest FROM lv) WHERE ts >= newest - INTERVAL 6 HOUR) GROUP BY key""", "lv")
def merge_leader(t):
    return graph.merge_leader(graph.leaves(t.c), F.expr("INTERVAL 6 HOURS"))


@query("SELECT o_orderkey FROM orders ORDER BY md5('7/' || o_orderkey), o_orderkey")
def shuffle(t):
    return t.orders.select("o_orderkey").orderBy(F.md5(F.concat(lit("7/"), col("o_orderkey").cast("string"))), "o_orderkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey")
def sort_orderstamp(t):
    return t.part.select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


# --- Sets ----------------------------------------------------------------------------------


@query("SELECT id, list_sort(list_distinct(list_concat(a, b))) AS s FROM k", "k")
def set_union(t):
    return t.k.select("id", F.sort_array(F.array_union("a", "b")).alias("s"))


@query("SELECT id, list_sort(list_intersect(a, b)) AS s, CAST(len(list_intersect(a, b)) AS INT) AS n FROM k", "k")
def set_intersect(t):
    return t.k.select("id", F.sort_array(F.array_intersect("a", "b")).alias("s"), F.size(F.array_intersect("a", "b")).alias("n"))


@query("SELECT id, list_filter(a, lambda x: NOT list_contains(b, x)) AS s FROM k", "k")
def set_except(t):
    return t.k.select("id", F.sort_array(F.array_except("a", "b")).alias("s"))


@query("SELECT id, list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))) AS s FROM k", "k")
def set_symdiff(t):
    return t.k.select("id", fn.set_difference(col("a"), col("b")).alias("s"))


@query("SELECT id, a = b AS same FROM k", "k")
def set_equals(t):
    return t.k.select("id", fn.set_equal(col("a"), col("b")).alias("same"))


@query("SELECT id, list_sort(CASE WHEN list_contains(a, id % 200) THEN list_filter(a, lambda x: x <> id % 200) ELSE list_append(a, id % 200) END) AS s FROM k", "k")
def set_toggle(t):
    return t.k.select("id", fn.toggle(col("a"), col("id") % 200).alias("s"))


@query("SELECT id, list_sort(list_distinct(list_transform(list_filter(a, lambda x: x % 2 = 0), lambda x: x // 10))) AS s FROM k", "k")
def set_map_filter(t):
    even = F.filter("a", lambda x: x % 2 == 0)
    return t.k.select("id", F.sort_array(F.array_distinct(F.transform(even, lambda x: F.floor(x / 10)))).alias("s"))


@query("SELECT path FROM i WHERE ns = '1-URGENT' UNION ALL SELECT path FROM i WHERE o_custkey % 2 = 0", "i")
def union_all(t):
    return t.i.filter("ns = '1-URGENT'").select("path").unionByName(t.i.filter("o_custkey % 2 = 0").select("path"))
