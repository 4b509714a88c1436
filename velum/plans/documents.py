"""Registered queries over scalar functions, documents, the commit graph, rich text and live views."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.functions import columns as fn
from velum.functions import richtext
from velum.operators import bloom, graph, merge
from velum.operators.schema import Field, Schema, SchemaRegistry, normalize, validate
from velum.plans.catalog import col, lit, query
from velum.sources.log import scratch_dir
from velum.streaming import live


# --- Scalars -----------------------------------------------------------------------------


@query(
    """SELECT path, 'data' AS kind, 'orders' AS repo, CAST(o_orderkey AS VARCHAR) AS item, CAST(NULL AS VARCHAR) AS embed, '/data/orders' AS repo_id, path AS normal, path || '/x' AS joined, TRUE AS valid FROM i""",
    "i",
)
def path_functions(t):
    p = F.ltrim(col("path"), lit("/"))
    parts = [fn.path_part(p, n + 1).alias(x) for n, x in enumerate(("kind", "repo", "item", "embed"))]
    messy = F.concat(lit("//data///orders/"), col("o_orderkey").cast("string"), lit("/"))
    return t.i.select("path", *parts, fn.path_repo(p).alias("repo_id"), fn.path_normalize(messy).alias("normal"), fn.path_join(F.concat(col("path"), lit("/")), lit("/x")).alias("joined"), fn.path_valid(col("path")).alias("valid"))


@query("SELECT doc_id, substr(text, 1, 3) || '--' || substr(text, 6) AS s FROM documents")
def str_splice(t):
    return t.documents.select("doc_id", fn.splice(col("text"), 3, 2, "--").alias("s"))


@query(
    """SELECT p_partkey, CAST(len(list_filter(range(1, length(a) + 1), lambda i: i <= length(b) AND substr(a, 1, i) = substr(b, 1, i))) AS INT) AS n,
    CAST(len(list_filter(range(1, length(a) + 1), lambda i: i <= length(b) AND right(a, i) = right(b, i))) AS INT) AS m, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS o
    FROM (SELECT p_partkey, p_name AS a, coalesce(lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey), '') AS b FROM part)"""
)
def str_common_prefix(t):
    d = t.part.select("p_partkey", col("p_name").alias("a"), F.coalesce(F.lag("p_name").over(W.partitionBy("p_brand").orderBy("p_name", "p_partkey")), lit("")).alias("b"))
    return d.select("p_partkey", fn.common_prefix(col("a"), col("b")).alias("n"), fn.common_suffix(col("a"), col("b")).alias("m"), fn.compare(col("a"), col("b")).alias("o"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN TRUE WHEN doc_id % 3 = 1 THEN NOT regexp_matches(text, '[A-Za-z\x{C0}-\x{2B8}\x{370}-\x{590}\x{900}-\x{1FFF}]') ELSE FALSE END AS rtl FROM documents WHERE text IS NOT NULL")
def str_is_rtl(t):
    """A third of the texts has Hebrew before it, a third behind it, a third begins with a Latin letter."""
    word, kind = lit("\u05e9\u05dc\u05d5\u05dd"), col("doc_id") % 3
    text = F.when(kind == 0, F.concat(word, lit(" "), "text")).when(kind == 1, F.concat("text", lit(" "), word)).otherwise(F.concat(lit("a "), "text"))
    return t.documents.filter("text is not null").select("doc_id", fn.is_rtl(text).alias("rtl"))


@query(r"""SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1) AS ext,
    rtrim(url, '/') || '/x.html' AS longer FROM pages""")
def file_path_functions(t):
    u = col("url")
    return t.pages.select("page_id", fn.dirname(u).alias("dir"), fn.basename(u).alias("base"), fn.extname(u).alias("ext"), fn.append_component(u, lit("/x.html")).alias("longer"))


@query("SELECT event_id, len(json_keys(props)) AS n, json_keys(props)[1] AS first FROM events")
def json_keys(t):
    keys = F.json_object_keys("props")
    return t.events.select("event_id", F.size(keys).cast("long").alias("n"), F.get(keys, lit(0)).alias("first"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email FROM customer")
def normalize_email(t):
    raw = F.when(col("c_custkey") % 3 == 0, col("c_name")).otherwise(F.concat(lit("  "), F.replace(col("c_name"), lit("#"), lit(".")), lit("@Example.com ")))
    return t.customer.select("c_custkey", fn.normalize_email(raw).alias("email"))


@query("SELECT page_id, CAST(len(regexp_extract_all(url, '[a-z]+')) AS INT) AS n FROM pages")
def regex_match_count(t):
    return t.pages.select("page_id", F.regexp_count("url", lit("[a-z]+")).alias("n"))


@query("SELECT doc_id, base64(encode(source)) AS packed, source AS back FROM documents")
def base64_roundtrip(t):
    packed = F.base64(F.encode("source", "UTF-8"))
    return t.documents.select("doc_id", packed.alias("packed"), F.decode(F.unbase64(packed), "UTF-8").alias("back"))


@query("SELECT event_id, epoch_us(ts) / 1e6 AS seconds, TRUE AS same FROM events")
def date_roundtrip(t):
    s = fn.seconds(col("ts"))
    return t.events.select("event_id", s.alias("seconds"), (fn.from_number(s) == col("ts").cast("timestamp")).alias("same"))


@query("SELECT event_id, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INT) AS DATE) AS week, CAST(date_trunc('month', ts) AS DATE) AS month FROM events")
def date_buckets(t):
    return t.events.select("event_id", col("ts").cast("date").alias("day"), fn.week_start(col("ts")).alias("week"), F.trunc(col("ts").cast("date"), "month").alias("month"))


@query("SELECT event_id, CAST(day(last_day(ts)) AS INT) AS days, CAST(day(last_day(ts)) - day(ts) AS INT) AS days_left FROM events")
def days_in_month(t):
    n = fn.days_in_month(col("ts"))
    return t.events.select("event_id", n.alias("days"), (n - F.day("ts")).alias("days_left"))


@query("SELECT event_id, CAST(greatest(0, 5 - dayofweek(ts)) AS INT) AS in_week, CAST(day(last_day(ts)) - (day(ts) - 1) AS INT) AS in_month FROM events")
def workdays_left(t):
    return t.events.select("event_id", fn.workdays_left_in_week(col("ts")).alias("in_week"), (fn.days_in_month(col("ts")) - (F.day("ts") - 1)).alias("in_month"))


@query("SELECT event_id, CASE DATE '2024-01-15' - CAST(ts AS DATE) WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE strftime(ts, '%Y-%m-%d') END AS label FROM events")
def relative_day_label(t):
    return t.events.select("event_id", fn.day_label(col("ts"), F.to_date(lit("2024-01-15"))).alias("label"))


@query("SELECT event_id, 8640000000000000 - epoch_us(ts) // 1000 AS reversed FROM events")
def reverse_ts(t):
    return t.events.select("event_id", (lit(fn.MAX_MS) - F.unix_millis(col("ts").cast("timestamp"))).alias("reversed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_quantity, 10.0), 40.0) AS q FROM lineitem")
def math_clip(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", fn.clip(col("l_quantity"), 10.0, 40.0).alias("q"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(x, 6) AS linear, round(x * x, 6) AS quad, round(-(cos(pi() * x) - 1) / 2, 6) AS sine,
    round(CASE WHEN x < 0.5 THEN 16 * pow(x, 5) ELSE 1 - pow(2 - 2 * x, 5) / 2 END, 6) AS quint, round(CASE WHEN x = 0 THEN 0 ELSE pow(2, 10 * x - 10) END, 6) AS expo FROM (SELECT *, l_discount * 10 AS x FROM lineitem)""")
def math_easing(t):
    x = col("l_discount") * 10
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(fn.ease(k, x), 6).alias(k) for k in ("linear", "quad", "sine", "quint", "expo")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, abs(l_discount - l_tax) < 2.220446049250313e-16 AS same FROM lineitem")
def num_approx_equal(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", fn.nearly_equal(col("l_discount"), col("l_tax")).alias("same"))


@query("SELECT n_nationkey, (1::BIGINT << 24) | (CAST(n_regionkey AS BIGINT) << 16) | (CAST(n_nationkey AS BIGINT) << 8) | 7 AS packed, '1.' || n_regionkey || '.' || n_nationkey || '.7' AS version FROM nation")
def version_tuple(t):
    packed = fn.pack_version(lit(1), col("n_regionkey"), col("n_nationkey"), lit(7))
    return t.nation.select("n_nationkey", packed.alias("packed"), fn.unpack_version(packed).alias("version"))


@query("SELECT n, CAST(ceil(n * ln(0.01) / ln(1 / pow(2, ln(2)))) AS BIGINT) AS bits FROM (VALUES (10), (1024), (100000)) v(n)")
def bloom_sizing(t):
    n = t.spark.createDataFrame([(10,), (1024,), (100000,)], "n int")
    return n.select("n", fn.bloom_bits(col("n"), lit(0.01)).alias("bits"))


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS n, embedding[1] AS first, embedding[-1] AS last, embedding[2:4] AS part FROM embeddings")
def array_basic(t):
    e = col("embedding")
    return t.embeddings.select("vec_id", F.size(e).alias("n"), F.get(e, lit(0)).alias("first"), F.element_at(e, -1).alias("last"), F.slice(e, 2, 3).alias("part"))


@query("SELECT doc_id, quality IS NOT DISTINCT FROM toxic AS same FROM d", "d")
def null_safe_equal(t):
    return t.d.select("doc_id", col("quality").eqNullSafe(col("toxic")).alias("same"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 1 AS n FROM events")
def map_roundtrip(t):
    m = F.map_from_entries(F.map_entries(F.from_json("props", "map<string,int>")))
    return t.events.select("event_id", F.try_element_at(m, lit("k")).alias("k"), F.size(m).alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


# --- Documents and schemas -------------------------------------------------------------------

DOCUMENT = Schema("document", 1, {"text": Field("string", True), "quality": Field("int", True, 0), "n_chars": Field("bigint", False, None, lambda c: c < 5000)})


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'text is required' WHEN quality IS NULL THEN 'quality is required' WHEN n_chars >= 5000 THEN 'n_chars is invalid' END AS message FROM d", "d")
def validate_rows(t):
    return t.d.select("doc_id", validate(DOCUMENT).alias("message"))


@query("SELECT doc_id, coalesce(quality, 0) AS quality FROM d", "d")
def normalize_rows(t):
    return normalize(DOCUMENT, t.d).select("doc_id", "quality")


@query("SELECT o_orderkey, o_orderstatus AS status, round(o_totalprice / 2, 4) AS half, 3 AS version FROM orders")
def schema_upgrade(t):
    r = SchemaRegistry()
    r.register(Schema("order", 1, {}))
    r.register(Schema("order", 2, {}, lambda df: df.withColumnRenamed("o_orderstatus", "status")))
    r.register(Schema("order", 3, {}, lambda df: df.withColumns({"half": F.round(col("o_totalprice") / 2, 4), "version": lit(3)})))
    return r.upgrade(t.orders, "order", 1).select("o_orderkey", "status", "half", "version")


@query("SELECT key, CASE WHEN p0 IS DISTINCT FROM p1 THEN p0 END AS removed, CASE WHEN p0 IS DISTINCT FROM p1 THEN p1 END AS added FROM t", "t")
def field_diff(t):
    return t.t.withColumn("x", merge.diff(col("p0"), col("p1"))).select("key", "x.removed", "x.added")


@query("SELECT key, concat_ws(',', CASE WHEN p0 IS DISTINCT FROM p1 THEN 'price' END, CASE WHEN s0 IS DISTINCT FROM s1 THEN 'priority' END, CASE WHEN u0 IS DISTINCT FROM u1 THEN 'status' END) AS names FROM t", "t")
def diff_keys(t):
    return t.t.select("key", F.array_join(merge.changed_names({"price": (col("p0"), col("p1")), "priority": (col("s0"), col("s1")), "status": (col("u0"), col("u1"))}), ",").alias("names"))


@query("SELECT key, CASE WHEN s1 IS NOT NULL AND s1 IS DISTINCT FROM s0 THEN s1 ELSE s2 END AS patched FROM t", "t")
def field_patch(t):
    d = merge.diff(col("s0"), col("s1"))
    return t.t.select("key", F.when(d.isNull(), col("s2")).otherwise(merge.patch_value(col("s2"), d["removed"], d["added"])).alias("patched"))


@query("SELECT a.doc_id, a.text = b.text AND a.lang = b.lang AS same FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1")
def doc_equal(t):
    other = t.documents.select((col("doc_id") + 1).alias("doc_id"), F.struct("lang", "text").alias("b"))
    return t.documents.select("doc_id", F.struct("lang", "text").alias("a")).join(other, "doc_id").select("doc_id", col("a").eqNullSafe(col("b")).alias("same"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN CAST(json_extract_string(props, '$.k') AS INT) + 1 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events")
def map_diff_patch(t):
    m = F.from_json("props", "map<string,int>")
    changed = F.when(col("event_id") % 3 == 0, F.create_map().cast("map<string,int>")).when(col("event_id") % 3 == 1, F.transform_values(m, lambda k, v: v + 1)).otherwise(m)
    return t.events.select("event_id", F.try_element_at(merge.map_patch(m, merge.map_diff(m, changed)), lit("k")).alias("k"))


def _kmap(x, step):
    return f"SELECT id, x AS k, x + {step} * ((x + {len(x)}) % 2) AS v FROM (SELECT id, unnest({x}) AS x FROM k)"


@query(
    f"""WITH o AS ({_kmap('base', 0)}), p AS ({_kmap('a', 1000)}), q AS ({_kmap('b', 1000)}),
    e AS (SELECT id, k, o.v AS o, p.v AS p, q.v AS q FROM o FULL JOIN p USING (id, k) FULL JOIN q USING (id, k)),
    m AS (SELECT id, k, CASE WHEN q IS NOT NULL AND q IS DISTINCT FROM o THEN q WHEN p IS NOT NULL AND p IS DISTINCT FROM o THEN p WHEN p IS NOT NULL AND q IS NOT NULL THEN o END AS v FROM e)
    SELECT k.id, coalesce(string_agg(m.k || ':' || m.v, ',' ORDER BY m.k), '') AS merged FROM k LEFT JOIN m ON m.id = k.id AND m.v IS NOT NULL GROUP BY k.id""",
    "k",
)
def merge_map(t):
    """Maps that share a base are merged key by key: the newest change to a value wins, and a removal counts where no side set one."""
    made = lambda c, step: F.map_from_entries(F.transform(c, lambda x: F.struct(x.alias("key"), (x + step * ((x + len(c)) % 2)).alias("value"))))
    merged = merge.merge_maps(made("base", 0), made("a", 1000), made("b", 1000))
    pairs = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return t.k.select("id", F.array_join(pairs, ",").alias("merged"))


@query("SELECT id, list_sort(list_filter(b, lambda x: NOT list_contains(base, x) OR list_contains(a, x))) AS patched0, list_sort(list_distinct(list_concat(list_filter(b, lambda x: NOT (list_contains(base, x) AND NOT list_contains(a, x))), list_filter(a, lambda x: NOT list_contains(base, x))))) AS patched FROM k", "k")
def set_diff_patch(t):
    """What changed from the base to one side, applied to the other side."""
    d = merge.set_diff(col("base"), col("a"))
    removed = F.sort_array(F.array_except("b", d["removed"]))
    return t.k.select("id", removed.alias("patched0"), F.sort_array(merge.set_patch(col("b"), d)).alias("patched"))


@query("SELECT id, list_sort(list_distinct(list_transform(a, lambda x: CASE WHEN x % 10 = 0 THEN x + 1 ELSE x END))) AS refs FROM k", "k")
def rewrite_refs(t):
    new = F.transform("a", lambda x: F.when(x % 10 == 0, x + 1).otherwise(x))
    return t.k.select("id", F.sort_array(F.array_distinct(new)).alias("refs"))


@query("SELECT user_id AS key, event_type AS field, min(event_id) AS first FROM events GROUP BY 1, 2")
def mutation_first_per_field(t):
    return t.events.groupBy(col("user_id").alias("key"), col("event_type").alias("field")).agg(F.min("event_id").alias("first"))


# --- Commit graph ----------------------------------------------------------------------------


@query("SELECT doc_id, doc_id % 7 = 0 AS corrupted FROM documents")
def corruption_check(t):
    stored = F.when(col("doc_id") % 7 == 0, F.md5(F.concat(col("text"), lit("!")))).otherwise(F.md5("text"))
    return t.documents.select("doc_id", (stored != F.md5("text")).alias("corrupted"))


@query(
    """WITH w(id, up) AS (SELECT id, id FROM c UNION ALL SELECT w.id, c.parent FROM w JOIN c ON w.up = c.id WHERE c.id % 7 = 0 AND c.parent IS NOT NULL)
    SELECT c.id, g.up AS found FROM c LEFT JOIN (SELECT id, up FROM w WHERE up % 7 <> 0) g ON g.id = c.id""",
    "c",
    recursive=True,
)
def latest_good_commit(t):
    """Every commit, or where it is corrupt its nearest ancestor that isn't."""
    return graph.nearest(t.c, col("id") % 7 != 0)


@query(
    """WITH h AS (SELECT key, arg_max(id, (ts, id)) AS id FROM lv GROUP BY key), w(id, up) AS (SELECT id, id FROM h UNION ALL SELECT w.id, c.parent FROM w JOIN c ON w.up = c.id WHERE c.id % 7 = 0 AND c.parent IS NOT NULL)
    SELECT h.key, h.id, c.value FROM h LEFT JOIN w ON w.id = h.id AND w.up % 7 <> 0 LEFT JOIN c ON c.id = w.up""",
    "lv",
    recursive=True,
)
def value_at_commit(t):
    """The value at each key's head, that of the nearest good ancestor where the head is corrupt."""
    good = graph.nearest(t.c, col("id") % 7 != 0)
    return graph.heads(t.c).select("key", "id").join(good, "id").join(t.c.select(col("id").alias("found"), "value"), "found", "left").select("key", "id", "value")


@query("SELECT key, count(*) AS leaves FROM lv GROUP BY key HAVING count(*) > 1", "lv")
def keys_needing_merge(t):
    return graph.leaves(t.c).groupBy("key").agg(F.count("*").alias("leaves")).filter("leaves > 1")


@query("SELECT key, CASE WHEN p1 IS DISTINCT FROM p0 THEN p1 ELSE p2 END AS price, CASE WHEN s1 IS DISTINCT FROM s0 THEN s1 ELSE s2 END AS priority FROM t", "t")
def rebase_local_wins(t):
    return t.t.select("key", merge.rebase_value(col("p0"), col("p1"), col("p2")).alias("price"), merge.rebase_value(col("s0"), col("s1"), col("s2")).alias("priority"))


@query("SELECT doc_id, length(source) + length(lang) <= 0.85 * (length(source) + length(lang) + length(text)) AS as_delta FROM documents")
def delta_ratio(t):
    small = F.length("source") + F.length("lang")
    return t.documents.select("doc_id", (small <= 0.85 * (small + F.length("text"))).alias("as_delta"))


@query("SELECT id FROM c WHERE parent IS NULL OR floor(value) IS DISTINCT FROM (SELECT floor(p.value) FROM c p WHERE p.id = c.parent)", "c")
def noop_write_elimination(t):
    other = t.c.select(col("id").alias("parent"), F.floor("value").alias("v"))
    return t.c.join(other, "parent", "left").filter(col("parent").isNull() | ~F.floor("value").eqNullSafe(col("v"))).select("id")


@query("WITH g(id, key, depth) AS (SELECT id, key, 0::BIGINT FROM c WHERE parent IS NULL UNION ALL SELECT c.id, c.key, g.depth + 1 FROM c JOIN g ON c.parent = g.id) SELECT id, key, depth FROM g", "c", recursive=True)
def graph_depth(t):
    return graph.depths(t.c)


@query("SELECT id, key FROM c WHERE parent IS NULL", "c")
def graph_roots(t):
    return graph.roots(t.c).select("id", "key")


@query("SELECT 'node' AS kind, id AS a, CAST(NULL AS BIGINT) AS b FROM c UNION ALL SELECT 'edge', parent, id FROM c WHERE parent IS NOT NULL", "c")
def graph_nodes_edges(t):
    nodes = t.c.select(lit("node").alias("kind"), col("id").alias("a"), lit(None).cast("long").alias("b"))
    return nodes.unionByName(graph.edges(t.c).select(lit("edge").alias("kind"), col("parent").alias("a"), col("child").alias("b")))


@query("SELECT key, arg_max(id, (ts, id)) AS id FROM c WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY key", "c")
def as_of_timestamp(t):
    return graph.as_of(t.c, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")).select("key", "id")


@query(
    """SELECT key, id FROM (SELECT h.key, CASE WHEN h.connection = 1 THEN arg_max(c.id, (c.ts, c.id)) FILTER (c.connection <> 1 AND c.ts < h.ts) ELSE h.id END AS id
    FROM (SELECT key, arg_max(id, (ts, id)) AS id, arg_max(connection, (ts, id)) AS connection, max(ts) AS ts FROM lv GROUP BY key) h JOIN c USING (key) GROUP BY h.key, h.id, h.connection, h.ts) WHERE id IS NOT NULL""",
    "lv",
)
def revert_by_connection(t):
    return graph.revert_connection(t.c, [1])


@query("SELECT id, coalesce(o.n, 0) AS children, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS parents FROM c LEFT JOIN (SELECT parent AS p, count(*) AS n FROM c WHERE parent IS NOT NULL GROUP BY 1) o ON o.p = c.id", "c")
def edge_in_out_degree(t):
    children = graph.edges(t.c).groupBy(col("parent").alias("id")).agg(F.count("*").alias("n"))
    return t.c.join(children, "id", "left").select("id", F.coalesce("n", lit(0)).alias("children"), F.when(col("parent").isNull(), 0).otherwise(1).alias("parents"))


# --- Rich text -------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, '{"root":{"children":[{"tag":"p","children":[{"text":' || CAST(to_json(role) AS VARCHAR) || '}]}]}}' AS tree FROM conversations""")
def plaintext_to_tree(t):
    text = F.struct(col("role").alias("text"))
    paragraph = F.struct(lit("p").alias("tag"), F.array(text).alias("children"))
    return t.conversations.select("conv_id", "turn", F.to_json(F.struct(F.struct(F.array(paragraph).alias("children")).alias("root"))).alias("tree"))


def _tree(*elements: tuple[str, Column]) -> Column:
    """A tree of elements, each of a tag and a text."""
    nodes = [F.struct(lit(tag).alias("tag"), F.array(F.struct(F.coalesce(text, lit("")).alias("text"))).alias("children")) for tag, text in elements]
    return F.to_json(F.struct(F.struct(F.array(*nodes).alias("children")).alias("root")))


def _titled(t):
    return t.conversations.select("conv_id", "turn", "role", "text", _tree(("h1", col("role")), ("p", col("text"))).alias("tree"))


_TURNS = "(SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)"


@query(
    f"""SELECT concat_ws('-', conv_id, turn) AS id, n.depth, n.path, n.tag, n.text, n.offset FROM (SELECT *, unnest([
    {{'depth': 0, 'path': '', 'tag': NULL, 'text': NULL, 'offset': 0}}, {{'depth': 1, 'path': '/0', 'tag': 'h1', 'text': NULL, 'offset': 0}}, {{'depth': 2, 'path': '/0/0', 'tag': NULL, 'text': role, 'offset': 0}},
    {{'depth': 1, 'path': '/1', 'tag': 'p', 'text': NULL, 'offset': length(role)}}, {{'depth': 2, 'path': '/1/0', 'tag': NULL, 'text': text, 'offset': length(role)}}]) AS n FROM {_TURNS})"""
)
def tree_dfs(t):
    return _titled(t).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "tree").mapInPandas(richtext.find_nodes, "id string, depth int, path string, tag string, text string, offset long")


@query(f"SELECT conv_id, turn, role || chr(10) || text AS plain FROM {_TURNS}")
def tree_to_plaintext(t):
    return _titled(t).select("conv_id", "turn", richtext.plain_text("tree").alias("plain"))


@query(f"SELECT conv_id, turn, chr(10) || '# ' || chr(10) || role || chr(10) || chr(10) || text AS markdown FROM {_TURNS}")
def tree_to_markdown(t):
    return _titled(t).select("conv_id", "turn", richtext.markdown("tree").alias("markdown"))


@query(f"SELECT conv_id, turn, TRUE AS same FROM {_TURNS}")
def tree_flatten_rebuild(t):
    return _titled(t).select("conv_id", "turn", (richtext.normal("tree") == col("tree")).alias("same"))


@query(f"SELECT conv_id, turn, role || chr(10) || text || ' (seen)' AS merged FROM {_TURNS}")
def merge_richtext(t):
    """One side puts a title before the paragraph, the other adds to its end."""
    base, local = _tree(("p", col("text"))), _tree(("p", F.concat(F.coalesce("text", lit("")), lit(" (seen)"))))
    return _titled(t).select("conv_id", "turn", richtext.plain_text(richtext.merge_richtext(base, col("tree"), local)).alias("merged"))


@query("SELECT user_id AS key, CAST(count(*) FILTER (ts > TIMESTAMP '2024-01-25') AS BIGINT) AS live FROM events GROUP BY 1")
def purge_expired(t):
    return t.events.groupBy(col("user_id").alias("key")).agg(F.count_if(col("ts") > F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'")).alias("live"))


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS ref FROM documents")
def extract_refs(t):
    return t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), lit(0))).alias("ref")).distinct()


# --- Live views --------------------------------------------------------------------------------

_HOT = "value > 50"


def _streamed(t):
    root = f"{scratch_dir(t.spark)}/velum-live/{uuid.uuid4().hex}"
    return live.follow(t.spark, t.sf_dir, "events.parquet", root, lambda s: s.select(col("event_id").alias("id"), col("user_id").alias("key"), "ts", "value"))


@query("SELECT key, id, value FROM (SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1) WHERE value > 50")
def incremental_view(t):
    return live.view(_streamed(t), F.expr(_HOT)).select("key", "id", "value")


@query("SELECT key, id, value FROM (SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1) WHERE value > 50")
def resume_from_age(t):
    commits = t.aged.select("key", "id", "ts", "value", "age")
    before = graph.latest(commits.filter("age <= 5000")).filter(_HOT).select("key", "id", "ts", "value", "age")
    return live.resume(before, commits, 5000, F.expr(_HOT)).select("key", "id", "value")


@query("SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY 1")
def late_data_head(t):
    return _streamed(t).select("key", "id")


@query("""SELECT user_id AS key, count(*) AS events, CAST(sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END) AS BIGINT) AS sessions
    FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY 1""")
def debounce_sessions(t):
    us = F.unix_micros(col("ts").cast("timestamp"))
    gap = us - F.lag(us).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select(col("user_id").alias("key"), gap.alias("gap")).groupBy("key").agg(F.count("*").alias("events"), F.count_if(col("gap").isNull() | (col("gap") > 21_600_000_000)).alias("sessions"))


@query("SELECT key FROM t WHERE s0 IS DISTINCT FROM s1 OR u0 IS DISTINCT FROM u1", "t")
def change_field_filter(t):
    names = merge.changed_names({"price": (col("p0"), col("p1")), "priority": (col("s0"), col("s1")), "status": (col("u0"), col("u1"))})
    return t.t.filter(F.arrays_overlap(names, F.array(lit("priority"), lit("status")))).select("key")


@query(
    """WITH a AS (SELECT event_id AS id FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id AS id FROM events WHERE event_id % 3 <> 1), n AS (SELECT greatest(1, (SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n),
    f AS (SELECT n, least(0.5::DOUBLE, pow(n, -2.0 / 3)) AS p FROM n), s AS (SELECT greatest(8, CAST(ceil(n * ln(p) / ln(1 / pow(2, ln(2)))) AS BIGINT)) AS bits, n FROM f),
    z AS (SELECT bits, least(8, greatest(1, CAST(round_even(bits / n * ln(2), 0) AS BIGINT))) AS hashes FROM s),
    h AS (SELECT DISTINCT CAST('0x' || substr(md5((k // 4) || '/' || id), (k % 4) * 8 + 1, 8) AS BIGINT) % bits AS pos FROM b, z, range(8) r(k) WHERE k < hashes)
    SELECT id FROM (SELECT id, CAST('0x' || substr(md5((k // 4) || '/' || id), (k % 4) * 8 + 1, 8) AS BIGINT) % bits AS pos FROM a, z, range(8) r(k) WHERE k < hashes) x LEFT JOIN h ON h.pos = x.pos GROUP BY id HAVING bool_or(h.pos IS NULL)"""
)
def sync_bloom_round(t):
    """What peer A sends in one round: its values that B's filter surely lacks."""
    e = t.events.select(col("event_id").alias("id"))
    a, b = e.filter("id % 3 <> 0"), e.filter("id % 3 <> 1")
    n = max(1, a.count(), b.count())
    bits, hashes = bloom.sizes(n, bloom.sync_rate(n))
    return bloom.absent(a, "id", bloom.fill(b, "id", bits, hashes), bits, hashes)


@query("SELECT event_id AS id, ts FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-31'")
def session_active_filter(t):
    return t.events.filter(F.expr("ts + INTERVAL 7 DAY > TIMESTAMP_NTZ '2024-01-31 00:00:00'")).select(col("event_id").alias("id"), "ts")
