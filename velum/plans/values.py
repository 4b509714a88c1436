"""Registered queries over strings, order stamps, mutation packs, merges of many tips and synchronisation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.functions import columns as fn
from velum.functions import orderstamp, text
from velum.operators import graph, merge, mutations, sync
from velum.plans.catalog import col, lit, query
from velum.sources.log import scratch_dir
from velum.streaming.cache import ResultCache, view_changes


# --- Strings ---------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN length(p_name) > 4 THEN CAST(unicode(substr(p_name, 5, 1)) AS INT) END AS code FROM part")
def str_code_point(t):
    return t.part.select("p_partkey", text.code_point_at(col("p_name"), 4).alias("code"))


@query(
    """SELECT c_custkey, left(c_name, length(c_name) - 1) || chr(unicode(right(c_name, 1)) + 1) AS following, left(c_name, length(c_name) - 1) || chr(unicode(right(c_name, 1)) - 1) AS preceding FROM customer"""
)
def str_next_previous(t):
    return t.customer.select("c_custkey", text.next_string(col("c_name")).alias("following"), text.previous_string(col("c_name")).alias("preceding"))


@query("SELECT c_custkey, CAST(8 * ceil(strlen(c_name) / 5) AS INT) AS n, c_name AS back FROM customer")
def base32_roundtrip(t):
    return t.customer.select("c_custkey", "c_name", text.base32_encode(col("c_name")).alias("code")).select("c_custkey", F.length("code").alias("n"), text.base32_decode(col("code")).alias("back"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'rtl' WHEN regexp_matches(coalesce(text, ''), '[A-Za-z_]') THEN 'ltr' ELSE 'auto' END AS direction FROM documents")
def str_direction(t):
    """A third of the texts has a Hebrew letter before it."""
    return t.documents.select("doc_id", text.direction(F.when(col("doc_id") % 3 == 0, F.concat(lit("1. א "), F.coalesce("text", lit("")))).otherwise(col("text"))).alias("direction"))


@query(
    r"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)(.*?[0-9]+)(?:.|$)')) AS w, unnest(regexp_extract_all(text, '(?s)(.*?[0-9]+)(?:.|$)', 1)) AS m, unnest(range(len(regexp_extract_all(text, '(?s)(.*?[0-9]+)(?:.|$)')))) AS n FROM documents)
    SELECT doc_id, CAST(n AS INT) AS n, CAST(coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(m) AS BIGINT) AS "end" FROM p"""
)
def regex_match_ends(t):
    return text.match_ends(t.documents, "doc_id", "text", "[0-9]+")


@query("SELECT event_id, TRUE AS valid FROM events")
def unique_ids(t):
    return t.events.select("event_id", text.unique_id().alias("id")).select("event_id", col("id").rlike("^[a-z0-9]{24}$").alias("valid"))


@query("SELECT page_id, '/a/' || page_id || '/c' AS up, '../x' AS relative, TRUE AS absolute, '/pages/' || page_id || ' 1' AS file FROM pages")
def path_resolve(t):
    i = col("page_id").cast("string")
    up = F.concat(lit("/../a/./b/..//"), i, lit("/z/../c/"))
    file = text.from_file_url(F.concat(lit("file:///pages/"), i, lit("%201")))
    return t.pages.select("page_id", text.resolve_path(up).alias("up"), text.resolve_path(F.concat(i, lit("/.././../x"))).alias("relative"), text.is_absolute(up).alias("absolute"), file.alias("file"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TRUE ELSE FALSE END AS made FROM events")
def create_paths(t):
    """Half of the paths name an item already."""
    given = F.when(col("event_id") % 2 == 0, lit("/data/events")).otherwise(F.concat(lit("/data/events/"), col("event_id").cast("string")))
    return t.events.select("event_id", given.alias("given"), text.create_path(given).alias("path")).select("event_id", (col("path").rlike("^/data/events/[a-z0-9]{24}$") & (col("path") != col("given"))).alias("made"))


@query("SELECT o_orderkey, CAST(o_orderkey * 86400000 AS BIGINT) AS days, CAST(o_orderkey * 3600000 AS BIGINT) AS hours, 8640000000000000 - epoch_ms(o_orderdate::TIMESTAMP) AS stamp, epoch_ms(o_orderdate::TIMESTAMP) AS back FROM orders")
def time_units(t):
    ms = F.unix_millis(col("o_orderdate").cast("timestamp"))
    stamp = fn.reverse_ms(ms)
    return t.orders.select("o_orderkey", fn.to_ms(col("o_orderkey"), "day").alias("days"), fn.to_ms(col("o_orderkey"), "hour").alias("hours"), stamp.alias("stamp"), fn.reverse_ms(stamp).alias("back"))


@query("SELECT o_orderkey, CAST(10 + CAST('0x' || substr(md5('3/' || o_orderkey), 1, 8) AS BIGINT) % 90 AS BIGINT) AS n FROM orders")
def random_int(t):
    return t.orders.select("o_orderkey", fn.random_int(col("o_orderkey"), 10, 100, 3).alias("n"))


@query("SELECT user_id AS key, CAST(ceil(log2(count(*))) AS BIGINT) AS n FROM events GROUP BY 1")
def leaf_agreement(t):
    return t.events.groupBy(col("user_id").alias("key")).agg(fn.agreement_size(F.count("*")).alias("n"))


@query("SELECT event_id, CASE WHEN props IS NULL THEN 'null' WHEN json_type(props) = 'OBJECT' THEN 'object' ELSE 'other' END AS outer_kind, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'null' END AS inner_kind FROM events")
def value_kinds(t):
    return t.events.select("event_id", fn.json_kind(col("props")).alias("outer_kind"), fn.json_kind(F.get_json_object("props", "$.k")).alias("inner_kind"))


@query("SELECT id, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS o, a = b AS same FROM k", "k")
def deep_compare(t):
    return t.k.select("id", fn.compare(col("a"), col("b")).alias("o"), col("a").eqNullSafe(col("b")).alias("same"))


@query("SELECT doc_id, text, lang FROM documents")
def doc_serialize(t):
    """Documents written as JSON and read back; absent fields stay absent."""
    packed = t.documents.select("doc_id", F.to_json(F.struct("text", "lang")).alias("j"))
    return packed.select("doc_id", F.from_json("j", "text string, lang string").alias("d")).select("doc_id", "d.*")


@query("SELECT DISTINCT c_custkey AS key, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS present FROM customer")
def key_exists(t):
    held = t.orders.select(col("o_custkey").alias("key")).distinct().withColumn("present", lit(True))
    return t.customer.select(col("c_custkey").alias("key")).join(held, "key", "left").select("key", F.coalesce("present", lit(False)).alias("present"))


# --- Order stamps ----------------------------------------------------------------------------


@query("SELECT p_partkey, TRUE AS ordered FROM part")
def orderstamp_between(t):
    """Between the stamps of a number and the next: one in the middle, one on each side of it."""
    d = t.part.select("p_partkey", orderstamp.of_number(col("p_partkey")).alias("a"), orderstamp.of_number(col("p_partkey") + 1).alias("b"))
    d = d.withColumn("m", orderstamp.between(col("a"), col("b")))
    d = d.withColumn("x", orderstamp.between(col("a"), col("m"))).withColumn("y", orderstamp.between(col("m"), col("b")))
    ordered = (orderstamp.start(lit(1)) < col("a")) & (col("a") < col("x")) & (col("x") < col("m")) & (col("m") < col("y")) & (col("y") < col("b")) & (col("b") < orderstamp.end(lit(1)))
    return d.select("p_partkey", ordered.alias("ordered"))


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INT) AS place FROM orders")
def orderstamp_prepend(t):
    """Orders put at the start of their customer's list one after the other."""
    stamped = t.orders.select("o_orderkey", "o_custkey", orderstamp.start(col("o_orderkey")).alias("stamp"))
    return stamped.select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("stamp")).alias("place"))


# --- Mutation packs --------------------------------------------------------------------------

_PACK = "p AS (SELECT l_orderkey AS id, list({'f': l_returnflag, 'l': l_linenumber % 2 = 1, 'v': l_partkey} ORDER BY l_linenumber, l_returnflag, l_partkey) AS pack FROM lineitem GROUP BY 1)"


def _packs(t):
    one = mutations.mutation(col("l_returnflag"), col("l_linenumber") % 2 == 1, col("l_partkey"))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("m"))))
    return t.lineitem.groupBy(col("l_orderkey").alias("id")).agg(F.transform(ordered, lambda x: x["m"]).alias("pack"))


@query(f"""WITH {_PACK}, e AS (SELECT id, unnest(pack) AS m, unnest(range(len(pack))) AS n FROM p), f AS (SELECT id, m.f AS field, arg_min(m.v, n) AS value, min(n) AS n FROM e GROUP BY ALL)
    SELECT id, list(value ORDER BY n) AS first FROM f GROUP BY id""")
def mutation_optimize(t):
    return _packs(t).select("id", F.transform(mutations.optimize(col("pack")), lambda m: m["value"]).alias("first"))


@query(f"""WITH {_PACK} SELECT id, len(list_filter(pack, lambda m: m.l)) > 0 AS local, len(list_filter(pack, lambda m: NOT m.l)) > 0 AS remote, len(list_filter(pack, lambda m: m.f = 'A' OR m.f = 'R')) > 0 AS returned,
    CAST(len(list_filter(pack, lambda m: m.f <> 'A')) AS INT) AS rest, CAST(len(pack) + 1 AS INT) AS more, CAST(len(list_filter(pack, lambda m: NOT list_contains(list_transform(pack[1:1], lambda x: x.f), m.f))) AS INT) AS others FROM p""")
def mutation_tests(t):
    p = col("pack")
    return _packs(t).select(
        "id",
        mutations.has_local(p).alias("local"),
        mutations.has_remote(p).alias("remote"),
        mutations.has_field(p, "A", "R").alias("returned"),
        F.size(mutations.delete_field(p, "A")).alias("rest"),
        F.size(mutations.append(p, p[0])).alias("more"),
        F.size(mutations.subtract_fields(p, F.slice(p, 1, 1))).alias("others"),
    )


@query("SELECT l_orderkey AS id, l_returnflag AS field, arg_max(l_partkey, (l_linenumber, l_partkey)) AS value FROM lineitem GROUP BY 1, 2")
def mutation_apply(t):
    return _packs(t).select("id", F.explode(mutations.apply(F.create_map().cast("map<string,bigint>"), col("pack"))).alias("field", "value"))


# --- Merging and synchronising ---------------------------------------------------------------


@query(
    """WITH tp AS (SELECT key, connection, max(ts) AS ts, arg_max(id, (ts, id)) AS id, arg_max(value, (ts, id)) AS value FROM lv GROUP BY 1, 2),
    sv AS (SELECT key, count(*) AS n FROM tp GROUP BY 1 HAVING count(*) > 1),
    up(start, id) AS (SELECT tp.id, tp.id FROM tp JOIN sv USING (key) UNION ALL SELECT up.start, c.parent FROM up JOIN c ON up.id = c.id WHERE c.parent IS NOT NULL),
    cn AS (SELECT c.key, c.id, c.ts, count(*) AS m FROM up JOIN c ON c.id = up.id GROUP BY ALL), an AS (SELECT cn.key, cn.id, cn.ts FROM cn JOIN sv ON sv.key = cn.key AND cn.m = sv.n),
    ba AS (SELECT key, arg_max(id, (ts, id)) AS base FROM an GROUP BY 1)
    SELECT sv.key, ba.base, sv.n AS tips, coalesce(arg_max(tp.value, (tp.ts, tp.id)) FILTER (tp.value IS NOT NULL AND tp.value IS DISTINCT FROM o.value), CASE WHEN NOT bool_or(tp.value IS NULL) THEN max(o.value) END) AS value
    FROM sv JOIN tp USING (key) LEFT JOIN ba USING (key) LEFT JOIN c o ON o.id = ba.base GROUP BY sv.key, ba.base, sv.n""",
    "lv",
    recursive=True,
)
def merge_n_way(t):
    return graph.merge_tips(t.spark, t.c, ["value"])


@query("SELECT DISTINCT event_id AS id FROM events")
def sync_converge(t):
    """What the second peer has once both have everything."""
    e = t.events.select(col("event_id").alias("id")).distinct()
    return sync.converge(e.filter("id % 3 <> 0"), e.filter("id % 3 <> 1"), "id")[1]


@query("SELECT k.id, coalesce(r.a, []) AS a FROM k LEFT JOIN (SELECT id, list_sort(list(DISTINCT CASE WHEN p_partkey IS NULL THEN x ELSE x + 1000000 END)) AS a FROM (SELECT id, unnest(a) AS x FROM k) LEFT JOIN part ON p_partkey = x AND p_partkey % 10 = 0 GROUP BY id) r USING (id)", "k")
def rewrite_refs_by_table(t):
    moved = t.part.filter("p_partkey % 10 = 0").select(col("p_partkey").alias("old"), (col("p_partkey") + 1000000).alias("new"))
    return merge.rewrite_refs(t.k, "id", "a", moved)


@query("SELECT id, CASE WHEN len(list_concat(a, b)) > 0 THEN list_concat(a, b) END AS changes FROM k", "k")
def concat_changes(t):
    return t.k.select("id", merge.concat_changes(col("a"), lit(None).cast("array<bigint>"), col("b")).alias("changes"))


@query("SELECT id, list_filter(a, lambda x: x % 2 = 0) = list_filter(b, lambda x: x % 2 = 0) AS same FROM k", "k")
def set_equals_where(t):
    return t.k.select("id", fn.set_equal_where(col("a"), col("b"), lambda x: x % 2 == 0).alias("same"))


@query("SELECT event_id, event_id % 2 = 0 AND props IS NOT NULL OR props IS NULL AS same FROM events")
def map_equals(t):
    """Each map with itself in another order, or with one more entry."""
    m = F.from_json("props", "map<string,string>")
    other = F.map_concat(F.create_map(lit("__a"), F.when(col("event_id") % 2 == 0, "1").otherwise("2")), m)
    return t.events.select("event_id", fn.map_equal(F.map_concat(m, F.create_map(lit("__a"), lit("1"))), other).alias("same"))


@query("SELECT DISTINCT l_orderkey AS vertex, l_partkey AS neighbour, TRUE AS outgoing FROM lineitem UNION ALL SELECT DISTINCT l_partkey, l_orderkey, FALSE FROM lineitem")
def neighbours(t):
    return graph.neighbours(t.lineitem, "l_orderkey", "l_partkey")


_NOW = "SELECT key, arg_max(id, (ts, id)) AS id, arg_max(value, (ts, id)) AS value FROM c{0} GROUP BY 1"


@query(f"SELECT key, id, value FROM ({_NOW.format('')}) WHERE value > 50", "c")
def cached_view(t):
    """A view stored as of the first commits, then brought up to date from where it stood."""
    commits = t.aged.select("key", "id", "ts", "value", "age")
    cache = ResultCache(t.spark, f"{scratch_dir(t.spark)}/velum-cache/{uuid.uuid4().hex}")
    cache.view("hot", commits.filter("age <= 500"), col("value") > 50)
    return cache.view("hot", commits, col("value") > 50).select("key", "id", "value")


@query(
    f"""WITH b AS (SELECT * FROM ({_NOW.format(' WHERE age <= 500')}) WHERE value > 50), a AS (SELECT * FROM ({_NOW.format('')}) WHERE value > 50)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key WHERE b.key IS NULL OR a.key IS NULL OR a.id <> b.id OR a.value <> b.value""",
    "c",
)
def view_change_events(t):
    at = lambda rows: graph.latest(rows).filter("value > 50").select("key", "id", "value")
    return view_changes(at(t.aged.filter("age <= 500")), at(t.aged))
