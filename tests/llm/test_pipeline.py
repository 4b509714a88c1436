import corpus_pipeline
from tests.llm.fixtures import SCHEMA, docs, prose


def test_stages_take_effect(spark, tmp_path):
    where = str(tmp_path)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    extra = [(100 + k, prose(("en", "de")[k % 2], 50, 900 + k), ("en", "de")[k % 2], f"src{k % 3}", 0, "x") for k in range(40)]
    frame = docs(spark).unionByName(spark.createDataFrame(extra, SCHEMA)).withColumnRenamed("size", "n_chars").select(*columns)
    frame.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, extra[0][1]), (2, extra[1][1])], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontaminate", "mix_sources", "shard"]
    now, seen = spark.read.parquet(f"{where}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, where).write.parquet(f"{where}/{name}")
        now = spark.read.parquet(f"{where}/{name}")
        seen[name] = [x.doc_id for x in now.collect()]
        assert now.columns == columns or name == "shard"
    assert {0, 1, 2, 3}.isdisjoint(seen["language_id"]) and {8, 9, *range(100, 140)} <= set(seen["language_id"])
    assert 6 not in seen["simhash_dedup"] and 7 not in seen["simhash_dedup"] and set(range(100, 140)) <= set(seen["simhash_dedup"])
    assert {100, 101}.isdisjoint(seen["decontaminate"]) and set(range(102, 140)) <= set(seen["decontaminate"])
    assert set(seen["mix_sources"]) <= set(seen["decontaminate"]) and sorted(seen["shard"], key=str) == sorted(seen["mix_sources"], key=str)
    assert sorted(map(str, corpus_pipeline.run(spark, where).drop("text").collect())) == sorted(map(str, now.drop("text").collect()))
