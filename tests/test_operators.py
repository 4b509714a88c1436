import itertools
import random

import pytest
from pyspark.sql import functions as F

from velum.functions import columns as fn
from velum.operators import bloom, graph, merge
from velum.operators.query import Query
from velum.operators.schema import Field, Schema, SchemaRegistry, normalize, validate
from velum.sources import log
from velum.streaming.live import LiveHeads

ITEMS = "path string, ns string, is_deleted boolean, age long, title string, count double"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"/d/i/{i}", "a" if i % 4 else "b", True if i == 5 else None if i == 6 else False, i, f"Item {i}", None if i == 7 else float(i % 10)) for i in range(20)] + [("/d/i/x", None, False, 20, "none", 1.0)]
    return spark.createDataFrame(rows, ITEMS)


def paths(df):
    return [x.path for x in df.collect()]


def test_query_filters_sorts_and_limits(items):
    q = Query(items, F.col("count") > 5, schema="a", sort_by="count", descending=True, limit=3)
    assert paths(q.results()) == ["/d/i/9", "/d/i/19", "/d/i/18"]
    assert q.count().first().n == 5
    assert paths(Query(items, schema="a", sort_by="count", limit=2).results()) == ["/d/i/7", "/d/i/10"]  # missing first
    assert len(paths(Query(items).results())) == 20 and len(paths(Query(items, limit=100).results())) == 20
    assert paths(Query(items, limit=2).results()) == ["/d/i/0", "/d/i/1"]


def test_query_chains_finds_and_has(items, spark):
    inner = Query(items, lambda ctx: F.col("count") >= ctx["low"], ctx={"low": 8.0})
    outer = Query(inner, F.col("age") < 10)
    assert sorted(paths(outer.results())) == ["/d/i/8", "/d/i/9"]
    assert Query(items, sort_by="age", descending=True).find("count", 3.0).first().path == "/d/i/13"
    asked = spark.createDataFrame([("/d/i/8",), ("/d/i/5",)], "path string")
    assert {x.path: x.has for x in inner.has(asked).collect()} == {"/d/i/8": True, "/d/i/5": False}
    assert outer.id == Query(inner, F.col("age") < 10).id != Query(inner, F.col("age") < 10, limit=1).id != inner.id


def fold(base, sides):
    """Changes of all sides against one base, applied in order."""
    ops = [(base, s) for s in sides if s != base]
    now = base
    for removed, _ in ops:
        now = None if now == removed else now
    for _, added in ops:
        now = added if added is not None else now
    return now


def test_merge_value_equals_the_fold_of_changes(spark):
    rows = list(itertools.product([None, "a", "b"], repeat=4))
    got = spark.createDataFrame(rows, "o string, x string, y string, z string").select("*", merge.merge_value(*[F.col(c) for c in "oxyz"]).alias("m")).collect()
    for r in got:
        assert r.m == fold(r.o, [r.x, r.y, r.z]), r


def test_merge_sets_is_a_union_of_changes(spark):
    r = random.Random(1)
    pick = lambda: sorted(r.sample("abcdef", r.randint(0, 5)))
    rows = [(pick(), pick(), pick()) for _ in range(200)]
    df = spark.createDataFrame(rows, "o array<string>, x array<string>, y array<string>")
    one, two = merge.merge_sets(F.col("o"), F.col("x"), F.col("y")), merge.merge_sets(F.col("o"), F.col("y"), F.col("x"))
    for x in df.select("*", one.alias("one"), two.alias("two"), merge.merge_sets(F.col("o"), F.col("x"), F.col("x")).alias("same")).collect():
        o, a, b = set(x.o), set(x.x), set(x.y)
        assert set(x.one) == (o | a | b) - (o - a) - (o - b) and x.one == x.two and x.same == sorted(a)


def test_graph(spark):
    rows = [(1, "k", None, 1), (2, "k", 1, 2), (3, "k", 1, 3), (4, "k", 2, 4), (5, "j", 99, 5), (6, "k", 3, 4)]
    c = spark.createDataFrame(rows, "id long, key string, parent long, ts long")
    assert {x.id for x in graph.leaves(c).collect()} == {4, 5, 6}
    assert {(x.key, x.id) for x in graph.heads(c).collect()} == {("k", 6), ("j", 5)}  # equal times: greater id
    assert [(x.child, x.parent) for x in graph.missing_parents(c).collect()] == [(5, 99)]
    assert {x.id: x.depth for x in graph.depths(c.filter("key = 'k'")).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 6: 2}
    pairs = spark.createDataFrame([("k", 4, 6), ("k", 4, 2)], "key string, a long, b long")
    assert {(x.a, x.b): x.base for x in graph.common_ancestor(spark, c, pairs).collect()} == {(4, 6): 1, (4, 2): 2}
    assert {x.key: x.id for x in graph.as_of(c, F.lit(3)).collect()} == {"k": 3}


def test_schema(spark):
    s = Schema("doc", 1, {"name": Field("string", True), "n": Field("int", False, 7, lambda c: c < 10), "tags": Field("array<string>")})
    df = spark.createDataFrame([("a", 1, []), (None, 1, ["x"]), ("b", 50, None), ("c", None, ["y"])], "name string, n int, tags array<string>")
    assert [x.m for x in df.select(validate(s).alias("m")).collect()] == [None, "name is required", "n is invalid", None]
    assert [(x.n, x.tags) for x in normalize(s, df).collect()] == [(1, None), (1, ["x"]), (50, None), (7, ["y"])]
    r = SchemaRegistry()
    r.register(s)
    with pytest.raises(ValueError):
        r.register(Schema("doc", 3, {}))
    r.register(Schema("doc", 2, {}, lambda d: d.withColumn("v", F.lit(2))))
    assert r.get("doc").version == 2 and r.upgrade(df, "doc", 1).columns[-1] == "v"


def test_log_keeps_what_stands_before_a_broken_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1"}\n\n{"id":"2"}\n{"id":"3"')
    schema = spark.createDataFrame([], "id string").schema
    assert [x.id for x in log.read_json_log(spark, str(tmp_path), schema).orderBy("id").collect()] == ["1", "2"]
    old = spark.createDataFrame([("1",)], "id string")
    assert [x.id for x in log.append_new(old, spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "id string")).collect()] == ["2"]
    with pytest.raises(ValueError):
        log.readonly_sql(spark, "DROP TABLE x")


def test_live_heads_take_late_and_repeated_commits(spark, tmp_path):
    live = LiveHeads(spark, str(tmp_path))
    make = lambda rows: spark.createDataFrame(rows, "id long, key string, ts long, value double")
    live.apply(make([(5, "k", 50, 1.0), (6, "j", 10, 2.0)]), 0)
    live.apply(make([(3, "k", 30, 9.0), (6, "j", 10, 2.0), (7, "j", 10, 3.0)]), 1)
    assert {(x.key, x.id, x.value) for x in live.table().collect()} == {("k", 5, 1.0), ("j", 7, 3.0)}


def test_live_heads_go_on_after_a_restart(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "id long, key string, ts long")
    LiveHeads(spark, str(tmp_path)).apply(make([(5, "k", 50), (6, "j", 10)]), 0)
    (tmp_path / "v2").mkdir()  # a version that was never completed
    second = LiveHeads(spark, str(tmp_path))
    second.apply(make([(7, "j", 20), (1, "i", 1)]), 0)
    second.apply(make([(7, "j", 20), (1, "i", 1)]), 0)  # replayed
    assert {(x.key, x.id) for x in LiveHeads(spark, str(tmp_path)).table().collect()} == {("k", 5), ("j", 7), ("i", 1)}


def forest(made, n):
    """Rows in any order: parents of the same key or of another one, missing ones, roots."""
    rows = [(i, f"k{made.randrange(6)}" if made.random() < 0.2 else f"k{i % 3}", None if made.random() < 0.02 or i < 3 else i + 100_000 if made.random() < 0.02 else max(0, i - made.randrange(1, 9)), i) for i in range(n)]
    made.shuffle(rows)
    return rows


@pytest.fixture
def small_batches(spark, monkeypatch):
    monkeypatch.setattr(graph, "BATCH", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def paths_up(rows):
    up = {r[0]: r[2] for r in rows}

    def path(i):
        out = []
        while i in up:
            out.append(i)
            i = up[i]
        return out, i

    return up, path


def test_depths_and_nearest_by_brute_force(spark, small_batches):
    rows = forest(random.Random(7), 600)
    up, path = paths_up(rows)
    c = spark.createDataFrame(rows, "id long, key string, parent long, ts long")
    for given in (c, c.orderBy("key", "ts")):
        depth = {i: len(p) - (end is None) for i in up for p, end in [path(i)]}
        assert {r.id: r.depth for r in graph.depths(given).collect()} == depth
        near = {i: next((x for x in path(i)[0] if x % 7), None) for i in up}
        assert {r.id: r.found for r in graph.nearest(given, F.col("id") % 7 != 0).collect()} == near


@pytest.mark.parametrize("walk", ["depths", "nearest"])
def test_keys_that_stand_together_take_no_rounds(spark, monkeypatch, walk):
    """Rows that have come to their end took part in each round's join, all of them in the task of null."""
    c = spark.range(0, 6600, 1, 2).select("id", F.floor(F.col("id") / 66).alias("key"), F.when(F.col("id") % 66 > 0, F.col("id") - 1).alias("parent"))
    names, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or write(df, name))
    got = graph.depths(c).filter("depth <> id % 66") if walk == "depths" else graph.nearest(c, F.col("id") % 66 < 9).filter("found <> id - greatest(0, id % 66 - 8)")
    assert got.isEmpty() and names == ["jumps"]


def test_common_ancestors_by_brute_force(spark, small_batches):
    made = random.Random(8)
    rows = forest(made, 500)
    up, path = paths_up(rows)
    keys = {r[0]: r[1] for r in rows}
    asked = sorted({(keys[a], a, b) for a in up for b in [made.choice(list(up)), up[a], max(0, a - made.randrange(30))] if b in up})
    asked += [("none", 1, 2), (None, 3, 4)]
    want = {(k, a, b): x for k, a, b in asked for x in [next((x for x in path(a)[0] if x in set(path(b)[0])), None)] if x is not None}
    c, pairs = spark.createDataFrame(rows, "id long, key string, parent long, ts long"), spark.createDataFrame(asked, "key string, a long, b long")
    assert {(r.key, r.a, r.b): r.base for r in graph.common_ancestor(spark, c, pairs).collect()} == want


def test_ancestors_of_whole_keys_take_one_pass(spark, monkeypatch):
    c = spark.range(6600).select("id", F.floor(F.col("id") / 66).alias("key"), F.when(F.col("id") % 66 > 1, F.col("id") - 2).when(F.col("id") % 66 == 1, F.col("id") - 1).alias("parent"))
    pairs = c.filter("id % 66 = 65").select("key", F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    monkeypatch.setattr(graph, "jump_index", None)
    assert graph.common_ancestor(spark, c, pairs).filter("base = 66 * key").count() == 100


def test_depth_of_a_long_chain_and_a_cycle(spark):
    chain = spark.range(20_000).select("id", F.lit("k").alias("key"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.col("id").alias("ts"))
    assert graph.depths(chain).agg(F.max("depth")).first()[0] == 19_999
    assert graph.nearest(chain, F.col("id") % 5000 == 0).filter("id = 14999").first().found == 10_000
    ring = spark.createDataFrame([(1, "k", 2), (2, "k", 1)], "id long, key string, parent long")
    with pytest.raises(ValueError):
        graph.depths(ring)


def test_arrivals_of_one_day_are_numbered_in_order(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10).alias("ts"))
    got = log.number_arrivals(df).collect()
    assert [x.id for x in sorted(got, key=lambda x: x.age)] == sorted(range(1000), key=lambda i: (i % 10, i)) and {x.age for x in got} == set(range(1, 1001))


def test_only_selects_are_run(spark):
    df = spark.range(3)
    assert log.readonly_sql(spark, "select 'drop; table' as x, id from {t} -- delete\n;", t=df).count() == 3
    for bad in ("with x as (select 1) insert into y select * from x", "select 1; drop table x", "selection"):
        with pytest.raises(ValueError):
            log.readonly_sql(spark, bad)


def test_bloom_has_no_false_negatives(spark):
    values = spark.range(500).select(F.col("id").alias("v"))
    bits, hashes = bloom.sizes(500, 0.01)
    filled = bloom.fill(values, "v", bits, hashes)
    assert bloom.absent(values, "v", filled, bits, hashes).count() == 0
    others = spark.range(1000, 2000).select(F.col("id").alias("v"))
    assert bloom.absent(others, "v", filled, bits, hashes).count() > 950
    assert 0.2 < bloom.fill_rate(filled, bits).first()[0] < 0.7


def test_paths_and_strings(spark):
    df = spark.createDataFrame([("/sys/r/i/e", "a@B.com ", "abcX", "abcY"), ("sys/r", "nope", "", "q")], "p string, m string, a string, b string")
    got = df.select(*[fn.path_part(F.col("p"), k).alias(f"x{k}") for k in (1, 2, 3, 4)], fn.path_repo(F.col("p")).alias("repo"), fn.normalize_email(F.col("m")).alias("mail"), fn.common_prefix(F.col("a"), F.col("b")).alias("n")).collect()
    assert tuple(got[0]) == ("sys", "r", "i", "e", "/sys/r", "a@b.com", 3)
    assert tuple(got[1]) == ("sys", "r", None, None, "/sys/r", None, 0)


def test_bloom_queries_size_their_filter_by_the_rows(spark):
    from types import SimpleNamespace

    from velum.plans import catalog, documents

    for n in (300, 60_000, 150_000):
        t = SimpleNamespace(events=spark.range(n).withColumnRenamed("id", "event_id"))
        sent = documents.sync_bloom_round(t)
        assert sent.filter("id % 3 <> 1").isEmpty() and sent.count() >= 0.9 * n / 3
        assert 0.3 < catalog.bloom_fill(t).first()[0] < 0.7
