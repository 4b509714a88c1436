import json
import random

from velum.functions import richtext as rt


def tree(*texts):
    return {"root": {"children": [{"tag": "p", "children": [{"text": x}]} for x in texts]}}


def some(rng):
    return tree(*["".join(rng.choice("ab c\n\U0001f600") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 4))])


def test_changes_lead_from_one_to_the_other():
    rng = random.Random(5)
    for _ in range(500):
        a, b = rt.atoms(some(rng)), rt.atoms(some(rng))
        out, at = [], 0
        for start, end, values in rt.changes(a, b):
            assert at <= start <= end
            out += a[at:start] + values
            at = end
        assert out + a[at:] == b


def test_texts_that_differ_throughout_are_replaced_as_a_whole():
    a, b = rt.atoms(tree(" ".join(f"a{i}" for i in range(900)))), rt.atoms(tree(" ".join(f"b{i}" for i in range(900))))
    assert rt.rebuild(rt.atoms(rt.merge_trees(rt.rebuild(a), [rt.rebuild(b)]))) == rt.rebuild(b)


def test_merge_with_one_changed_side_is_that_side():
    rng = random.Random(6)
    for _ in range(300):
        base, side = some(rng), some(rng)
        for sides in ([side], [base, side], [side, base], [side, side]):
            assert rt.merge_trees(base, sides) == rt.rebuild(rt.atoms(side))


def test_merge_keeps_both_insertions_and_removals():
    base = tree("hello world")
    assert rt.merge_trees(base, [tree("hello big world"), tree("hello world!")]) == tree("hello big world!")
    assert rt.merge_trees(base, [tree("world"), tree("hello world", "more")]) == tree("world", "more")
    both = rt.to_plain_text(rt.merge_trees(tree("a z"), [tree("a one z"), tree("a two z")]))
    assert set("one") <= set(both) and set("tw") <= set(both)
    assert rt.merge_trees({"root": {"children": []}}, [tree("x"), tree("x")]) == tree("x")


def test_merge_of_three_sides():
    base = tree("one two three")
    assert rt.merge_trees(base, [tree("zero one two three"), tree("one three"), tree("one two three four")]) == tree("zero one three four")


def test_rebuild_normalises():
    assert rt.rebuild([]) == tree("")
    assert rt.rebuild([("text", "a", "{}"), ("text", "b", "{}")]) == tree("ab")
    assert rt.rebuild([("open", "p", "{}"), ("text", "a", "{}")]) == tree("a")
    assert rt.rebuild([("close", "p", ""), ("open", "p", "{}"), ("close", "p", "")]) == tree("")
    bold = {"root": {"children": [{"tag": "p", "id": 7, "children": [{"text": "a"}, {"bold": True, "text": "b"}, {"tag": "a", "children": [{"text": "c"}]}]}]}}
    assert rt.rebuild(rt.atoms(bold)) == bold
    assert rt.rebuild(rt.atoms({"root": {"children": [{"tag": "p", "children": [{"text": "a"}, {"text": "b"}]}]}})) == tree("ab")


def test_plain_text_and_markdown():
    doc = {"root": {"children": [{"tag": "h1", "children": [{"text": "T"}]}, {"tag": "ul", "children": [{"tag": "li", "children": [{"text": "x"}]}, {"tag": "li", "children": [{"text": "y"}]}]}]}}
    assert rt.to_plain_text(doc) == "T\n\nx\ny"
    assert rt.to_markdown(doc) == "\n# \nT\n\n* \nx\n* \ny"
    assert rt.to_plain_text(rt.rebuild([])) == "" and rt.to_plain_text({"root": {}}) == ""


def test_columns_take_nulls(spark):
    df = spark.createDataFrame([(json.dumps(tree("a")), json.dumps(tree("a b"))), (None, json.dumps(tree("n"))), (json.dumps(tree("k")), None), (None, None)], "base string, side string")
    merged = rt.merge_richtext(df.base, df.side)
    got = df.select(rt.plain_text(merged).alias("x"), rt.markdown("base").alias("m"), rt.normal("side").alias("n")).collect()
    assert [x.x for x in got] == ["a b", "n", "k", None]
    assert [x.m is None for x in got] == [False, True, False, True] and [x.n is None for x in got] == [False, False, True, True]


def test_edits_are_fewest_at_any_size():
    r = random.Random(8)
    for n, signs in ((900, 3), (900, 400), (40, 2)):
        a, b = ([r.randrange(signs) for _ in range(n + r.randrange(9))] for _ in range(2))
        row = [0] * (len(b) + 1)  # longest common subsequence
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        found = rt._edits(a, b)
        assert sum(j - i + n - k for i, j, k, n in found) == len(a) + len(b) - 2 * row[-1]
        made, at = [], 0
        for i, j, k, n in found:
            made += a[at:i] + b[k:n]
            at = j
        assert made + a[at:] == b


def test_merge_keeps_both_sides_beyond_500_edits():
    words = [f"word{k}" for k in range(1200)]
    mine = [f"new{k}" if k % 2 else w for k, w in enumerate(words)]  # 600 scattered words
    theirs = words[:400] + words[405:]
    of = lambda x: tree(" ".join(x))
    merged = rt.to_plain_text(rt.merge_trees(of(words), [of(mine), of(theirs)])).split()
    assert [w for w in merged if w in words] == [w for k, w in enumerate(words) if not k % 2 and not 400 <= k < 405]
    assert all(merged.count(f"new{k}") == 1 for k in range(1, 1200, 2) if not 398 <= k < 408)
