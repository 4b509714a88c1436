"""Strings, order stamps, mutation packs, merges of many tips and rounds of synchronisation against plain Python."""

import base64
import random
import re

from pyspark.sql import functions as F

from velum.functions import columns as fn
from velum.functions import orderstamp, text
from velum.operators import bloom, graph, mutations, sync


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_base32_as_the_standard_library(spark):
    texts = ["", "a", "ab", "abc", "abcd", "abcde", "שלום", "x" * 101, "\x00\xff😀"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.base32_encode(F.col("t")).alias("c")).select("*", text.base32_decode(F.col("c")).alias("b")).collect()
    for r in rows:
        assert r.c == base64.b32encode(r.t.encode()).decode().lower().replace("=", "_", 1)
        assert r.b == r.t


def test_neighbours_in_order(spark):
    cases = ["a", "ab", "", "\U0010ffff", "a\x00", "퟿", "", "😀"]
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.next_string(F.col("t")).alias("n"), text.previous_string(F.col("t")).alias("p"), text.code_point_at(F.col("t"), 0).alias("c")).collect()
    assert [r.n for r in rows] == ["b", "ac", "\x01", "\U0010ffff\x01", "a\x01", "", "", "😁"]
    assert [r.p for r in rows] == ["`", "aa", "", "\U0010fffe", "a", "퟾", "퟿", "\U0001f5ff"]
    assert [r.c for r in rows] == [ord(t[0]) if t else None for t in cases]


def test_match_ends_by_brute_force(spark):
    made = random.Random(3)
    texts = ["", None, "12", "1a2", "a1", *["".join(made.choice("ab12 \n") for _ in range(made.randrange(60))) for _ in range(40)]]
    want = []
    for i, t in enumerate(texts):
        at, n = 0, 0
        while (m := re.compile("[12]+").search(t or "", at)) and at <= len(t):
            want.append((i, n, m.end()))
            at, n = m.end() + 1, n + 1
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert sorted(map(tuple, text.match_ends(df, "i", "t", "[12]+").collect())) == want


def test_paths_and_direction(spark):
    assert one(spark, text.resolve_path(F.lit("/../a//./b/../c/"))) == "/a/c"
    assert one(spark, text.resolve_path(F.lit("a/../../b"))) == "../b"
    assert one(spark, text.resolve_path(F.lit("../../b"))) == "../../b"
    assert one(spark, text.resolve_path(F.lit("a/.."))) == "."
    assert one(spark, text.from_file_url(F.lit("file:///x/a+b%20c"))) == "/x/a+b c"
    assert one(spark, text.from_file_url(F.lit("https://x"))) is None
    assert [one(spark, text.direction(F.lit(t))) for t in ("12 א b", "b א", "12", None)] == ["rtl", "ltr", "auto", "auto"]


def test_order_stamps_stay_in_order(spark):
    """Stamps put between random neighbours, 60 rounds of one row each, and hard pairs."""
    pairs = [("A", "B"), ("A", "A01"), ("A", "A1"), ("A", "A001"), ("Az", "B"), ("AzzV", "B1"), ("A", "A2"), ("1", "z"), ("B", "A"), ("A", "A")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", orderstamp.between(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        assert (r.a < r.s < r.b and not r.s.endswith("0")) if r.a < r.b else r.s is None
    made, chain = random.Random(5), spark.createDataFrame([("A1", "A2", k) for k in range(50)], "a string, b string, k int").select("a", "b", "k")
    for _ in range(8):
        side = F.element_at(F.array(*[F.lit(made.random() < 0.5) for _ in range(50)]), F.col("k") + 1)
        chain = spark.createDataFrame(chain.withColumn("s", orderstamp.between(F.col("a"), F.col("b"))).withColumn("go", side).select(F.when(F.col("go"), F.col("a")).otherwise(F.col("s")).alias("a"), F.when(F.col("go"), F.col("s")).otherwise(F.col("b")).alias("b"), "k").collect(), chain.schema)
    assert all(r.a < r.b for r in chain.collect())
    numbers = [-5, -1, 0, 1, 10, 1 << 40]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert [r.n for r in df.orderBy(orderstamp.of_number(F.col("n"))).collect()] == numbers
    assert [r.n for r in df.orderBy(orderstamp.end(F.col("n"))).collect()] == numbers
    assert [r.n for r in df.orderBy(orderstamp.start(F.col("n"))).collect()] == numbers[::-1]


def test_mutation_packs(spark):
    pack = F.array(*[mutations.mutation(F.lit(f), F.lit(loc), F.lit(v)) for f, loc, v in (("a", True, 1), ("b", True, 2), ("a", True, 3))])
    assert [m.value for m in one(spark, mutations.optimize(pack))] == [1, 2]
    assert one(spark, mutations.has_local(pack)) and not one(spark, mutations.has_remote(pack))
    none = F.lit(None).cast("array<struct<field:string,local:boolean,value:int>>")
    assert one(spark, mutations.is_empty(none)) and not one(spark, mutations.has_field(none, "a"))
    assert len(one(spark, mutations.append(none, pack[0]))) == 1
    assert [m.field for m in one(spark, mutations.subtract_fields(pack, F.slice(pack, 2, 1)))] == ["a", "a"]
    assert one(spark, mutations.apply(F.create_map(F.lit("a"), F.lit(9), F.lit("c"), F.lit(4)), pack)) == {"a": 3, "b": 2, "c": 4}


def test_merge_of_three_tips(spark):
    commits = spark.createDataFrame(
        [(1, "k", 0, None, 1, 5, "o"), (2, "k", 0, 1, 2, 6, "o"), (3, "k", 1, 1, 3, 5, "p"), (4, "k", 2, 2, 4, 5, None), (5, "j", 0, None, 5, 1, "x"), (6, "l", 0, None, 6, 1, "x"), (7, "l", 1, None, 7, 2, None)],
        "id long, key string, connection int, parent long, ts long, value int, name string",
    )
    rows = {r.key: r for r in graph.merge_tips(spark, commits, ["value", "name"]).collect()}
    assert set(rows) == {"k", "l"}
    # tips 3 and 4 (commit 2 has a child); base 1: no value differs from 5, the name is set by 3
    assert (rows["k"].base, rows["k"].tips, rows["k"].value, rows["k"].name) == (1, 2, 5, "p")
    assert (rows["l"].base, rows["l"].value, rows["l"].name) == (None, 2, "x")


def test_tips_of_whole_keys_need_no_tables_of_jumps(spark, monkeypatch):
    """Three tips a key; their base is the key's first commit, whose value no tip but the newest has left."""
    c = spark.range(300).select("id", F.floor(F.col("id") / 4).alias("key"), (F.col("id") % 4).alias("connection"), F.when(F.col("id") % 4 > 0, F.col("id") - F.col("id") % 4).alias("parent"), F.col("id").alias("ts"), F.when(F.col("id") % 4 == 3, 9).otherwise(5).alias("value"))
    monkeypatch.setattr(graph, "jump_index", None)
    rows = graph.merge_tips(spark, c, ["value"]).collect()
    assert sorted((r.key, r.base, r.tips, r.value) for r in rows) == [(k, 4 * k, 3, 9) for k in range(75)]


def test_rounds_end_with_both_peers_whole(spark):
    values = spark.range(3000).withColumnRenamed("id", "v")
    a, b, rounds = sync.converge(values.filter("v < 2000"), values.filter("v >= 1000"), "v")
    assert a.count() == b.count() == 3000 and 1 <= rounds < 10
    a, b, rounds = sync.converge(values.limit(0), values, "v")
    assert a.count() == 3000 and rounds <= 10
    assert [sync.cycles(ms) for ms in (10, 300, 400, 5000)] == [3, 3, 2, 1]


def test_rounds_take_a_row_for_each_value(spark):
    """No value is dealt out once for each of its bits; null is a value, and what occurs twice stays twice."""
    values = spark.range(40_000).withColumnRenamed("id", "v")
    n, (bits, hashes) = 20_000, bloom.sizes(20_000, bloom.sync_rate(20_000))
    count = bloom.blocks(n, bits)
    held, other = values.filter("v < 20000"), values.filter("v >= 20000")
    filled = bloom.fill_blocks(held, "v", count, 1)
    assert bloom.absent_blocks(held, "v", filled, count, 1).isEmpty()
    assert bloom.absent_blocks(other, "v", filled, count, 1).count() > 19_900
    got = sync.sent(other, held, "v", count, 1)
    assert sorted(r.v for r in got.collect()) == sorted(r.v for r in bloom.absent_blocks(values, "v", filled, count, 1).collect())
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    a = spark.createDataFrame([(1,), (2,), (None,)], "v long")
    b = spark.createDataFrame([(2,), (3,), (3,)], "v long")
    a, b, rounds = sync.converge(a, b, "v")
    assert rounds < 10
    for peer, want in ((a, [1, 2, 3, 3, None]), (b, [1, 2, 3, 3, None])):
        assert sorted((r.v for r in peer.collect()), key=str) == want
    # filters that hold everything: after the last round the rest is compared
    a, b, rounds = sync.converge(values.limit(5), values.filter("v < 9"), "v", most=0)
    assert rounds == 0 and a.count() == b.count() == 9


def test_kinds_of_json(spark):
    kinds = {'{"a":1}': "object", "[1]": "array", "1": "number", "1.5": "number", '"x"': "string", "true": "boolean", "null": "null", "plain": "string"}
    rows = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", fn.json_kind(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == kinds


def test_cached_view_goes_on(spark, tmp_path):
    from velum.streaming.cache import ResultCache, view_changes

    rows = [("a", 1, 1, 60, 1), ("b", 2, 2, 70, 2), ("a", 3, 3, 10, 3), ("c", 4, 1, 99, 4), ("b", 5, 1, 5, 5)]
    commits = spark.createDataFrame(rows, "key string, id long, ts long, value long, age long")
    cache, hot = ResultCache(spark, str(tmp_path)), F.col("value") > 50
    first = cache.view("hot", commits.filter("age <= 2"), hot)
    assert sorted(r.key for r in first.collect()) == ["a", "b"]
    again = ResultCache(spark, str(tmp_path))
    assert again.age("hot") == 2 and again.age("other") is None
    # b's commit 5 is late, so commit 2 stays its head although the batch holds only commit 5
    now = again.view("hot", commits, hot)
    assert sorted((r.key, r.id) for r in now.collect()) == [("b", 2), ("c", 4)]
    assert again.age("hot") == 5 and again.view("hot", commits, hot).count() == 2
    assert sorted(map(tuple, view_changes(first.select("key", "id"), now.select("key", "id")).collect())) == [("a", "removed"), ("c", "added")]
