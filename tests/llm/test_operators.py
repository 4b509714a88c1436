import hashlib
import math
import random
import re
import struct
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import ROWS, TEXTS, docs, empty, prose
from velum.llm.automaton import Automaton
from velum.llm.decontaminate import drop_contaminated, with_contamination
from velum.llm.graph import connected_components, local_components
from velum.llm.language import LanguageFilter, _counted, keep_known_languages, ngrams, train_language_filter, with_language
from velum.llm.linededup import line_dedup
from velum.llm.mixing import apply_mix, mix, targets
from velum.llm.pii import BASE, LOOSE, NEEDS, candidates, estimate_reliabilities, find_pii
from velum.llm.secrets import Scanner, with_secrets
from velum.llm.sharding import lookup_table, shard_names, with_shards
from velum.llm.simhash import _links, _nearest, _others, fingerprint, likely_pairs, link_fingerprints, near_dedup, similar_to, simhash_components, word_fingerprints
from velum.llm.tokens import BytePairs, with_token_counts
from velum.llm.topk import top_k


def peak_mb(run) -> float:
    run()  # tables that are kept
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


# --- Top-k -----------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-1.5, -0.25, 0.0, 0.3, 2.0]) for _ in range(5)]) for i in range(300)]
    rows += [(300, None), (301, [math.nan] * 5), (302, [None] * 5), (303, [math.inf] * 5), (304, [1.0, 2.0]), (306, [1.0, 2.0]), (None, [1.0] * 5), (305, []), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for x in top_k(df, df.filter("vec_id % 50 = 0 or vec_id = 304")).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
        assert x["rank"] == len(got[x.query_id])
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))]
    for q in [*range(0, 300, 50), 304]:
        v = dict(good)[q]
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:5]
        assert got[q] == [(i, -s) for s, i in scored]
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [300000.0, 1.0]), (1, [-1e8, 2.0]), (2, [1e8, 0.5]), (3, [0.0, -1e14]), (4, [2.5e5, 1e3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = sorted((-sum(a * b for a, b in zip(whole[0], whole[i])), i) for i in whole if i)
    assert [(x.vec_id, x.score) for x in top_k(df, df.filter("vec_id = 0")).orderBy("rank").collect()] == [(i, -s) for s, i in want]
    for bad in ([1e11, 1e11], [1e30, 0.0]):  # a score, then a component
        wide = spark.createDataFrame([(0, bad), (1, bad)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="leaves 64 bits|2\\*\\*62"):
            top_k(wide, wide).collect()


# --- Language --------------------------------------------------------------------------------


def test_language_filter_learns_and_bears_edges(spark):
    train = spark.createDataFrame([(i, prose(lang, 50, i), lang) for i, lang in enumerate(["en", "de"] * 30)], "doc_id long, text string, lang string")
    model = train_language_filter(train)
    assert model.langs == ["de", "en"]
    out = {x.doc_id: x for x in with_language(docs(spark), model).filter("doc_id is not null").collect()}
    assert [out[i].language.lang for i in (0, 1, 2, 3)] == ["und"] * 4 and out[0].language.score == 0
    assert out[4].language.lang in model.langs and out[8].language.lang == "en" and out[9].language.lang == "de"
    assert all(0 <= x.language.score <= 1 and 0 <= x.language.coverage <= 1 for x in out.values())
    kept = {x.doc_id for x in keep_known_languages(docs(spark), model).collect()}
    assert kept.isdisjoint({0, 1, 2, 3}) and {5, 8, 9} <= kept
    held = [prose(lang, 12, 1000 + k) for k, lang in enumerate(["en", "de"] * 20)]
    assert [p["lang"] for p in model.predict(held)] == ["en", "de"] * 20
    assert with_language(empty(spark), model).count() == 0


def test_language_without_training_rows(spark):
    model = train_language_filter(empty(spark))
    assert {x.language.lang for x in with_language(docs(spark), model).collect()} == {"und"}


def test_language_masks_return_all_languages():
    names = [f"l{k:02}" for k in range(20)]
    same = np.arange(50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    model = LanguageFilter.build(names, [same] * 20, "l00")
    a, b = model.places(same, len(model.slots))
    assert ((model.slots[a] & model.slots[b]) == (1 << 20) - 1).all()


def test_language_filter_learns_more_than_a_word_of_languages(spark):
    names = [f"l{k:03}" for k in range(130)]
    own = [np.arange(50, dtype=np.uint64) + np.uint64(1000 * k) for k in range(130)]
    model = LanguageFilter.build(names, [h * np.uint64(0x9E3779B97F4A7C15) for h in own], "l000")
    assert len(model.more) == 2 and len(model.false_rate) == 130
    words = ["".join(chr(97 + (k * 7 + j * (k // 26 + 1)) % 26) for j in range(9)) for k in range(70)]
    rows = [(10 * k + j, " ".join([words[k]] * 20), f"l{k:03}") for k in range(70) for j in range(2)]
    model = train_language_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 70
    assert [p["lang"] for p in model.predict([" ".join([w] * 3) for w in words])] == model.langs


def test_language_holds_few_ngrams_at_once():
    texts = [prose(("en", "de")[k % 2], 400, k) for k in range(2000)]  # 4 million letters
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 1000), pa.array(texts)], names=["lang", "text"])
    counts = Counter()
    for x in _counted(iter([batch])):
        assert len(set(x.column("h").to_pylist())) == x.num_rows
        for lang, h, n in zip(*(c.to_pylist() for c in x.columns)):
            counts[lang, h] += n
    for k, lang in enumerate(["en", "de"]):
        h, n = np.unique(np.concatenate([h for _, h in ngrams(texts[k::2])]), return_counts=True)
        assert {(lang, a): b for a, b in zip(h.view(np.int64).tolist(), n.tolist())} == {x: m for x, m in counts.items() if x[0] == lang}
    model = LanguageFilter.build(["de", "en"], [np.unique(np.concatenate([h for _, h in ngrams(texts[k:200:2])])) for k in (1, 0)], "en")
    assert [p["lang"] for p in model.predict(texts)] == ["en", "de"] * 1000
    assert model.predict(texts[:9]) == [model.predict([t])[0] for t in texts[:9]]
    assert peak_mb(lambda: [x.num_rows for x in _counted(iter([batch]))]) < 50
    assert peak_mb(lambda: model.predict(texts)) < 30


# --- Tokens ------------------------------------------------------------------------------------


def test_tokens_equal_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    own = BytePairs.from_file(path)
    r = random.Random(5)
    signs = "ab  \n\t '’st éßاب中0９Ⅷ½ 　\x1c\x85​дЖ😀.,!<|>_~́A"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a<|endoftext|> b", "a" * 3000, " " * 7, "aaa bbb" * 50, "we're I'll x's"]
    assert own.count_texts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    out = with_token_counts(docs(spark), path)
    assert out.count() == len(ROWS)
    for x in out.collect():
        text = x.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (x.n_bytes, x.n_tokens, x.over_limit) == (len(text.encode()), n, n > 512)
    assert with_token_counts(empty(spark), path).count() == 0


# --- Sharding ------------------------------------------------------------------------------------


def test_lookup_table_is_even_stable_and_weighted():
    names = shard_names(20)
    full = lookup_table(names, 10_007)
    counts = np.bincount(full, minlength=20)
    assert counts.max() - counts.min() <= 1
    less = lookup_table(names[:-1], 10_007)
    moved = (full != less) & (full != 19)
    assert moved.mean() < 0.15
    heavy = np.bincount(lookup_table(["a", "b", "c"], 1009, [2, 1, 1]))
    assert abs(heavy[0] - 2 * heavy[1]) <= 3
    for bad in ((names, 100), ([], 7), (["a", "a"], 7), (["a", "b"], 7, [1, 0])):
        with pytest.raises(ValueError):
            lookup_table(*bad)


def test_shards_of_rows(spark):
    out = with_shards(docs(spark), shard_names(5), slots=101)
    rows = out.collect()
    assert len(rows) == len(ROWS) and set(out.columns) == set(docs(spark).columns) | {"slot"}
    table = lookup_table(shard_names(5), 101)
    assert all(x.shard == shard_names(5)[table[x.slot]] for x in rows)
    assert len({x.shard for x in rows if x.doc_id == 6}) == 1
    assert with_shards(empty(spark), shard_names(5), slots=101).count() == 0


# --- Near duplicates -------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_that_of_the_definition(spark):
    for t in TEXTS[:8] + TEXTS[9:]:
        assert fingerprint(t) % (1 << 64) == slow_fingerprint(t)
    row = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()
    assert fingerprint("one two three") == row[0]


def test_components_equal_brute_force(spark):
    r = random.Random(3)
    rows = []
    for g in range(40):
        words = prose("en", 120, 500 + g).split()
        for _ in range(r.randint(1, 12)):
            own = list(words)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = f"w{r.randrange(99)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " ", "a", "a"])] + [(None, "lonely text without id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    fps = [fingerprint(t) % (1 << 64) for i, t in rows if i is not None]
    u, v = zip(*[(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    want = local_components(np.array(u), np.array(v), len(fps)).tolist()
    for tile in (2048, 2):  # 2: nearly every bucket is dealt out in tiles
        got = {x.id: x.component_id for x in simhash_components(df, tile=tile).collect() if x.id is not None}
        assert [got[i] for i in range(len(fps))] == want
    kept = {x.doc_id for x in near_dedup(df, similarity=None).collect()}
    assert kept == set(want) | {None}


def test_nearest_links_equal_brute_force(spark):
    r = random.Random(9)
    fps = {r.getrandbits(64) - (1 << 63) for _ in range(30)} | {0, -1, 1}
    for f in sorted(fps):
        for _ in range(20):
            g = f ^ sum({1 << r.randrange(63) for _ in range(r.randint(1, 5))})
            fps.add(g)
    far = {(a, b): ((a ^ b) % (1 << 64)).bit_count() for a in fps for b in fps if b < a}
    want = {}
    for (a, b), d in far.items():
        if d <= 3:
            want[a] = min(want.get(a, (d, b)), (d, b))
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4)
    for tile in (2048, 2):
        assert {x.u: x.v for x in link_fingerprints(df, tile=tile, nearest=True).collect()} == {a: b for a, (_, b) in want.items()}


def test_word_fingerprints_are_those_of_single_words():
    for t in TEXTS[:8] + TEXTS[9:]:
        assert word_fingerprints(t, [42])[0] == fingerprint(t, width=1)
        assert len(word_fingerprints(t, [42, 43])) == 2


def test_near_dedup_finds_copies_of_others_than_the_smallest(spark):
    # each group's texts differ from the next group's by few words, from far ones by many
    rows, words = [], prose("en", 400, 77).split()
    r = random.Random(4)
    for g in range(12):
        for k in r.sample(range(400), 24):
            words[k] = f"g{g}w{k}"
        for c in range(6):
            own = list(words)
            own[r.randrange(400)] = f"copy{c}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert likely_pairs(df.withColumnRenamed("doc_id", "id"), df.select(F.col("doc_id").alias("id"))).count() <= 3 * len(rows)
    assert [x.doc_id for x in near_dedup(df).orderBy("doc_id").collect()] == list(range(0, 72, 6))


def test_near_dedup_counts_shingles(spark):
    words = [f"word{k}" for k in range(200)]
    near = [f"new{k}" if k in (30, 90, 150) else w for k, w in enumerate(words)]  # 15 of 196 shingles differ
    far = [f"new{k}" if k % 9 == 0 else w for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(reversed(words)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in near_dedup(df).collect()} == {1, 3, 4}


def test_near_dedup_tries_all_within_the_radius(spark):
    # all have the same words, so the same word fingerprints; only the last two are alike
    words = [f"word{k}" for k in range(200)]
    rows = [(k, " ".join(random.Random(k).sample(words, 200))) for k in range(30)]
    swapped = list(words)
    for k in (30, 90, 150):
        swapped[k], swapped[k + 1] = swapped[k + 1], swapped[k]  # 18 of 196 shingles differ
    rows += [(30, " ".join(words)), (31, " ".join(swapped))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(x.doc_id for x in near_dedup(df).collect()) == list(range(31))


def test_near_dedup_keeps_what_only_fingerprints_join(spark):
    common = "one two three " * 300  # most of the weight of the shingles, but few different ones
    rows = [(k, common + " ".join(f"own{k}x{j}" for j in range(12))) for k in range(3)] + [(3, None), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.component_id for x in simhash_components(df).collect()} == {0, 3}
    assert sorted(x.doc_id for x in near_dedup(df).collect()) == [0, 1, 2, 3]


def test_similar_to_brute(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(40)}" for _ in range(300)]
    texts = {0: " ".join(base), 90: None, 91: "", 92: "a b", 93: "A  b"}
    for k in range(1, 40):
        words = list(base)
        for _ in range(k):
            words[rng.randrange(300)] = f"x{rng.randrange(99)}"
        texts[k] = " ".join(words)
    pairs = [(k, 0) for k in range(1, 40)] + [(90, 91), (93, 92), (92, 0)]

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    wanted = {a for a, b in pairs if (x := shingles(texts[a])) & (y := shingles(texts[b])) and len(x & y) >= 0.8 * len(x | y)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    for buckets in (1, 256):
        assert {x.id for x in similar_to(df, spark.createDataFrame(pairs, "id long, rep long"), buckets=buckets).collect()} == wanted
    assert 2 < len(wanted) < 30


def test_near_dedup_edges(spark):
    got = [x.doc_id for x in near_dedup(docs(spark)).collect()]
    assert sorted(i for i in got if i is not None) == sorted(set(i for i in got if i is not None)) and got.count(None) == 2
    assert 5 in got and 6 not in got and 7 not in got
    assert near_dedup(empty(spark)).count() == 0 and simhash_components(empty(spark)).count() == 0


def test_connected_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_pairs_of_a_bucket_are_compared_in_parts():
    r = np.random.default_rng(3)
    fp = r.integers(0, 1 << 63, 2000, dtype=np.uint64) // np.uint64(1 << 40) << np.uint64(40)
    fp[1000:] = fp[:1000] ^ (np.uint64(1) << r.integers(0, 3, 1000).astype(np.uint64))
    none, number = np.zeros(len(fp), np.int64), np.arange(len(fp))
    rows = (none, none, fp, none + 2)
    more = (*rows, number, number, fp.view(np.int64))
    for run in (lambda **n: _links(rows, 3, **n), lambda **n: _nearest(rows, 3, **n), lambda **n: _others(more, 3, 5, 64, **n)):  # 4 million pairs
        found, at_once = ([c.tolist() for c in got] for got in (run(), run(pairs=1 << 23)))
        assert found[0] and found == at_once
        assert peak_mb(run) < 60


def test_a_group_met_under_many_keys_is_merged_as_it_is_found():
    n, keys = 600, 60
    none, number = np.zeros(n * keys, np.int64), np.tile(np.arange(n), keys)
    rows = (np.repeat(np.arange(keys), n), none, none.view(np.uint64), none + 2, number, number, none)
    u, v, d = _others(rows, 3, 512, 16)
    assert list(zip(u.tolist(), v.tolist())) == [(a, b) for a in range(n) for b in range(min(a, 512))] and not d.any()
    assert peak_mb(lambda: _others(rows, 3, 512, 16)) < 120


# --- Secrets -----------------------------------------------------------------------------------------


def test_secrets_equal_regular_expressions(spark):
    patterns = {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), "access": (r"AKIA[A-Z0-9]+", 16), "hex": (r"[0-9a-f]+", 32)}
    scanner = Scanner()

    def slow(text):
        out = []
        for k, (p, least) in enumerate(patterns.values()):
            for m in re.finditer(p, text or ""):
                if len(m.group(2) if k == 0 else m.group()) >= least:
                    out.append((m.start(), k, m.end()))
        return [(list(patterns)[k], s, e) for s, k, e in sorted(out)]

    r = random.Random(2)
    parts = ["password", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdefgh1", "x", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é", "\n", "😀", "\0", "y" * 600]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)] + TEXTS
    found = [[s for s in spans if s[0] in patterns] for spans in scanner.spans(texts)]
    assert found == [slow(t) for t in texts]
    assert [s[0] for s in scanner.spans(["x ghp_" + "z" * 36 + " -----BEGIN RSA PRIVATE KEY-----"])[0]] == ["github", "private_key"]
    rows = with_secrets(docs(spark)).collect()
    assert len(rows) == len(ROWS) and [s.kind for x in rows if x.doc_id == 12 for s in x.secrets] == ["assign", "access"]
    assert with_secrets(empty(spark)).count() == 0


def test_automaton_is_minimal():
    a = Automaton(["ab|ac"])
    assert len(a.next) == 4  # none, start, after a, accepted


# --- Mixing ---------------------------------------------------------------------------------------------


def test_targets_share_the_excess(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 50), (None, 40), ("d", 0)], "source string, source_size long")
    got = {x.source: x.target for x in targets(totals).collect()}
    want, free, left = {}, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, 1100.0
    size = {"a": 1000, "b": 10, "c": 50, "d": 0, None: 40}
    while free:
        share = left / sum(free.values())
        full = [s for s, w in free.items() if share * w >= 3 * size[s]]
        if not full:
            want |= {s: share * w for s, w in free.items()}
            break
        for s in full:
            want[s] = 3.0 * size[s]
            left -= want[s]
            del free[s]
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1100)


def test_mix_meets_targets(spark):
    r = random.Random(4)
    rows = [(i, prose("en", r.randint(0, 30), i), f"s{min(r.randrange(9), 3)}") for i in range(600)] + [(601, None, None), (602, "x y", None), (None, "z", "s0"), (7, "a b c", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mix(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for x in got:
        assert 0 <= x.taken <= 3 * x.size and x.taken % max(x.size, 1) == 0
        by[x.target, x.source_size].append(x)
    for (target, _), own in by.items():
        assert sum(x["size"] for x in own) == own[0].source_size
        assert abs(sum(x.taken for x in own) - target) <= max(x["size"] for x in own)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(2)).collect()))
    copies = apply_mix(df).groupBy("doc_id").count().collect()
    assert {x.doc_id: x["count"] for x in copies if x.doc_id not in (7, None)} == {x.id: x.times for x in got if x.times and x.id not in (7, None)}
    assert mix(empty(spark)).count() == 0 and mix(docs(spark)).count() == len(ROWS)
    assert apply_mix(empty(spark)).count() == 0


def test_mix_takes_as_many_repeats_as_fit(spark):
    rows = [(1, "a b c d", "s0")] * 300 + [(k, prose("en", 40, k), "s1") for k in range(2, 30)]
    got = [x for x in mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect() if x.id == 1]
    assert abs(sum(x.taken for x in got) - got[0].target) <= 4


def test_apply_mix_keeps_columns_of_any_name(spark):
    names = ["target", "bucket", "last", "times", "epochs", "source_size", "size", "taken", "weight", "budget", "plan"]
    df = spark.createDataFrame([(k, prose("en", 9, k), f"s{k % 3}", *range(len(names))) for k in range(60)], ["doc_id", "text", "source", *names])
    out = apply_mix(df)
    assert out.columns == df.columns and {tuple(x)[3:] for x in out.collect()} == {tuple(range(len(names)))}


# --- Personal data -------------------------------------------------------------------------------------------


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def slow_pii(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_equals_regular_expressions(spark):
    r = random.Random(3)
    parts = ["a@b.c", "_x@d.e", "@", ".", "a", "9", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+1 (555) 555-1234", "1.2.3.4", "255.", "256.", "00", "é", "😀", "\n", "+", "(5)", "%"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(600)] + ["1" * 20_000, "a." * 9000 + "@b.c", *TEXTS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for x in find_pii(df).collect():
        assert [tuple(s) for s in x.base] == slow_pii(texts[x.id])
    assert find_pii(docs(spark)).count() == len(ROWS) and find_pii(empty(spark)).count() == 0


def test_pii_adds_kinds_and_keeps_base(spark):
    df = spark.createDataFrame([(1, "my ssn 078-05-1120, mail a@b.com"), (2, "order 123-45-6789 version"), (3, "call 212-555-0199")], "doc_id long, text string")
    got = {x.id: x for x in find_pii(df).collect()}
    assert [tuple(s) for s in got[1].added] == [("ssn", 7, 18)] and [s.kind for s in got[1].base] == ["email"]
    assert not got[2].base and set(BASE) == {"email", "ip", "card", "phone"}


def test_pii_adds_what_the_votes_are_for(spark):
    good, bad = "4111111111111111", "4111111111111112"  # two cards side by side are no base card
    texts = [f"pay by card {good} {good} now", f"number {bad} {bad}", "tel (212) 555-0199", "id (012) 155-0199 x", "IBAN DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01", "write to bob (at) example (dot) com", "Dr Anna Smith", f"{good} and 123-45-6789"]
    texts = texts * 10 + ["call +1 (212) 555-0100 or mail a@b.com from 10.1.2.3"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.id: [(s.kind, texts[x.id][s.start : s.end]) for s in x.added] for x in find_pii(df).collect()}
    assert [got[i] for i in range(9)] == [
        [("card_group", good)] * 2,
        [],
        [("local_phone", "(212) 555-0199")],
        [],
        [("iban", "DE89 3704 0044 0532 0130 00")],
        [],
        [("spelled_email", "bob (at) example (dot) com")],
        [("name", "Dr Anna Smith")],
        [("ssn", "123-45-6789")],
    ]
    never = find_pii(df, votes=lambda kind, found, near: F.array(*[F.lit(1 if kind in BASE else -1)] * 3)).collect()
    assert not any(x.added for x in never) and {x.id: len(x.base) for x in never} == {x.id: len(x.base) for x in find_pii(df).collect()}


def slow_free(base, loose):
    return [s for s in loose if not any(b[1] < s[2] and s[1] < b[2] for b in base)]


def test_pii_candidates_equal_brute_force(spark):
    r = random.Random(12)
    parts = ["4111111111111111", "(212) 555-0199", "078-05-1120", "+1 212 555 0199", " ", " ", ", ", "a@b.com", "Dr Anna Smith", "é", "😀", "7", "-", "0049 30 123 4567", "bob [at] x.org", "DE89370400440532013000"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(400)] + [" ".join(["4111111111111111, (212) 555-0199 a@b.com"] * 1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for x in candidates(df).collect():
        loose = [(k, m.start(), m.end()) for k, p in LOOSE.items() for m in re.finditer(p, texts[x.doc_id]) if (NEEDS[k] or "" if k in NEEDS else "") in texts[x.doc_id]]
        assert [(s.kind, s.start, s.end) for s in x["__base"]] == slow_pii(texts[x.doc_id])
        assert [(s.kind, s.start, s.end) for s in x["__loose"]] == slow_free(slow_pii(texts[x.doc_id]), loose)


def test_pii_of_many_matches_takes_linear_time(spark):
    took = []
    for n in (20_000, 80_000):
        df = spark.createDataFrame([(1, "a@b.com 1.2.3.4 (212) 555-0199, " * n)], "doc_id long, text string")
        began = time.perf_counter()
        x = find_pii(df).first()
        took.append(time.perf_counter() - began)
        assert len(x.base) == 2 * n and (x.base[-1].end, x.base[n - 1].end) == (32 * n - 17, 32 * n - 25)
    assert took[1] < 10 * took[0] + 10


def test_reliabilities_favour_the_labeler_that_agrees():
    prior, right, posterior = estimate_reliabilities({(1, 1, 1): 50, (1, 1, -1): 20, (-1, -1, 1): 20, (-1, -1, -1): 50})
    assert right[0] > right[2] and posterior[1, 1, -1] > 0.5 > posterior[-1, -1, 1] and 0 < prior < 1


# --- Lines --------------------------------------------------------------------------------------------------


def spark_hash(values, seed=42):
    """The engine's 64-bit hash of texts and whole numbers, one after the other."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed % (1 << 64))
    return seed - (1 << 64) if seed >> 63 else seed


def slow_line_dedup(rows, words=50):
    """The lines that go of each (id, text), by the definition."""
    places, pieces = defaultdict(set), {}
    for i, t in rows:
        lines = (t or "").split("\n")
        hashes = [spark_hash([x]) for x in lines]
        marked = [False] + [spark_hash(hashes[k - 1 : k + 1]) % 2 == 0 for k in range(1, len(lines))]
        ends = [k for k in range(1, len(lines)) if marked[k] and not marked[k - 1]]
        cuts = [0] + [e + 1 for e in ends if e + 1 < len(lines)] + [len(lines)]
        own = {(a, b, True) for a, b in zip(cuts, cuts[1:]) if b - a >= 2}
        own |= {(k, k + 2, False) for k in range(len(lines) - 1)}
        own |= {(k, k + 1, False) for k in range(len(lines)) if len(lines[k].split()) >= words}
        who = (i, spark_hash([t]) if t is not None else 42)
        pieces[who] = lines, own
        for a, b, chunk in own:
            places[chunk, tuple(lines[a:b])].add((*who, a))
    dead = {}
    for who, (lines, own) in pieces.items():
        gone = {}
        for a, b, chunk in own:
            if min(places[chunk, tuple(lines[a:b])]) != (*who, a):
                for k in range(a, b):
                    gone[k] = gone.get(k, False) or chunk
        runs = []
        for k in sorted(gone):
            runs[-1].append(k) if runs and runs[-1][-1] == k - 1 else runs.append([k])
        dead[who] = {k for run in runs if any(gone[k] for k in run) or sum(len(lines[k].split()) for k in run) >= words for k in run}
    return dead


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(6)
    lines = [f"line {k} of the pool" for k in range(12)] + ["", "é", prose("en", 70, 9), prose("de", 30, 9), prose("de", 30, 10)]
    rows = [(i, "\n".join(r.choice(lines) if r.random() < 0.6 else f"own {i} {k}" for k in range(r.randint(1, 15)))) for i in range(150)] + [(150, None), (151, ""), (152, "\n\n\n")]
    shared = "\n".join(f"shared {k}" for k in range(20))
    rows += [(153, "head\n" + shared), (154, shared + "\ntail"), (155, "x\ny\nz\n" + shared), (156, shared + "\nfirst text"), (156, shared + "\nsecond text")]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(4)
    dead = slow_line_dedup(rows)
    kept = {who: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dead[who]) for who, t in zip([(i, spark_hash([t]) if t is not None else 42) for i, t in rows], [t for _, t in rows])}
    out = line_dedup(df).collect()
    assert sorted((x.doc_id, str(x.text), x.n_cut_lines) for x in out) == sorted((i, str(kept[i, v]), len(dead[i, v])) for i, v in [*kept, *list(kept)[:5]])
    assert all(sum(x.doc_id == i and x.n_cut_lines >= 19 for x in out) == (2 if i == 156 else 1) for i in (154, 155, 156))  # wherever the passage stands


def test_line_dedup_finds_short_passages_anywhere(spark):
    r = random.Random(8)
    own = lambda i, n: [f"only {i} {r.random()} {k}" for k in range(n)]
    rows, n_lines = [], {}
    for n in range(1, 9):
        passage = [prose("en", -(-56 // n), 100 * n + k) for k in range(n)]
        for c in range(6):
            i = len(rows)
            rows.append((i, "\n".join([*own(i, r.randrange(6)), *passage, *own(i, r.randrange(6))])))
            n_lines[i] = n if c else 0
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.n_cut_lines for x in line_dedup(df).collect()} == n_lines


def test_line_dedup_of_many_lines(spark):
    body = "\n".join(f"line {k}" for k in range(20_000))
    rows = [(1, body), (2, "start\n" + body + "\nend"), (3, "\n" * 50_000)]
    got = {x.doc_id: x for x in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == body and got[2].text == "start\nend" and got[2].n_cut_chunks == 1


def test_line_dedup_edges(spark):
    rows = line_dedup(docs(spark)).collect()
    assert len(rows) == len(ROWS) and len({x.text for x in rows if x.doc_id == 6}) == 1
    assert sum(x.doc_id is None and x.n_cut_lines == 0 for x in rows) == 2
    assert line_dedup(empty(spark)).count() == 0


# --- Benchmark ------------------------------------------------------------------------------------------------


def slow_items(text, items, width=8):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        own = split(t)
        for i in range(max(1, len(own) - width + 1)) if own else ():
            win = own[i : i + width]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_equals_brute_force(spark):
    items = [(1, prose("en", 12, 1)), (2, "first common line"), (3, None), (4, "..."), (5, prose("de", 9, 3)), (1, "Other text of item one"), (6, "é"), (None, "the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [x for x in items if x[0] is not None]
    for how in ({}, {"block_bytes": 16}):  # the latter: many blocks
        for x in with_contamination(docs(spark), bench, **how).collect():
            c = x.contamination
            assert (c.n_words, c.n_hit, c["items"]) == slow_items(x.text, known)
            assert sum(len(re.findall("[0-9A-Za-z\x80-\U0010ffff]+", x.text[s.start : s.end])) for s in c.spans) == c.n_hit
    left = {x.doc_id for x in drop_contaminated(docs(spark), bench, items=1).collect()}
    assert {10, 11}.isdisjoint(left) and {0, 1, 2, 3, 4} <= left
    nothing = bench.limit(0)
    assert drop_contaminated(docs(spark), nothing).count() == len(ROWS) and with_contamination(empty(spark), bench).count() == 0


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
