import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.hierarchy import comment_parent, contradictions, descendants, hierarchy

SCHEMA = "id string, parent_id string, depth int"


def tree(spark, rows, path=True, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    return hierarchy(df, "id", comment_parent(F.col("parent_id")), "depth", path)


def brute(rows):
    """state and depth of every id by walking up."""
    parent = {}
    for i, p, _ in rows:
        if i is None:
            continue
        q = None if p is None or not p.strip() or p.strip().lower().startswith("t3_") else p.strip().removeprefix("t1_")
        if i not in parent or (q is not None and (parent[i] is None or q < parent[i])):
            parent[i] = q
    out = {}
    for i in parent:
        seen, cur, n = [], i, 0
        while True:
            seen.append(cur)
            up = parent[cur]
            n += 1
            if up is None:
                out[i] = ("top", n)
            elif up not in parent:
                out[i] = ("orphan", n)
            elif up in seen:
                cycle = seen[seen.index(up) :]
                out[i] = ("cycle" if i in cycle else "below_cycle", None)
            else:
                cur = up
                continue
            break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    n = r.choice([30, 120])
    rows = [(f"n{i}", r.choice([None, "", "t3_x", f"t1_n{r.randrange(n + 3)}", f"n{r.randrange(n + 3)}", f"n{max(0, i - 1)}", f"t1_n{max(0, i - 1)}"]), r.choice([1, 2, None])) for i in range(n)]
    got = {x.id: (x.state, x.true_depth) for x in tree(spark, rows).collect()}
    assert got == brute(rows)


def test_deep_chain_with_paths(spark):
    rows = [(f"n{i:03}", None if i == 0 else f"t1_n{i - 1:03}", i + 1) for i in range(300)]
    t = tree(spark, rows)
    last = t.filter("id = 'n299'").first()
    assert last.true_depth == 300 and last.path.split("/") == [f"n{i:03}" for i in range(300)] and last.root == "n000"
    d = {x.id: x.descendants for x in descendants(t).collect()}
    assert d["n000"] == 299 and d["n299"] == 0
    assert contradictions(t).count() == 0
    assert descendants(t, links=True).filter("ancestor = 'n000' AND distance = 299").count() == 1


def test_hot_parent(spark):
    rows = [("top", None, 1)] + [(f"c{i}", "t1_top", 2) for i in range(500)]
    t = tree(spark, rows)
    assert t.filter("state = 'top' AND true_depth = 2").count() == 500
    assert descendants(t).filter("id = 'top'").first().descendants == 500


def test_hot_parents_stay_where_they_are(spark, monkeypatch):
    from tallyforge.operators import skew

    rows = [("top", None, 1), ("mid", "t1_top", 2)] + [(f"c{i}", "t1_mid", 3) for i in range(400)] + [(f"d{i}", f"t1_c{i}", 4) for i in range(50)] + [("x", "t1_y", 1), ("y", "t1_x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert skew.hot_keys(df, "parent_id") == ["t1_mid"]
    hot = hierarchy(df, "id", comment_parent(F.col("parent_id")), "depth")
    monkeypatch.setattr(skew, "hot_keys", lambda *_: [])
    plain = hierarchy(df, "id", comment_parent(F.col("parent_id")), "depth")
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, hot.collect())) and hot.count() == len(rows)


def test_hot_keys_are_all_found(spark):
    from tallyforge.operators import skew

    df = spark.createDataFrame([(f"k{i}",) for i in range(3000)] + [("a",)] * 30 + [("b",)] * 900 + [(None,)] * 500, "k string").repartition(7)
    assert skew.hot_keys(df, "k") == ["b"] and skew.hot_keys(df.limit(0), "k") == []


def test_defined_cases(spark):
    rows = [(None, "a", 1), ("a", None, None), ("a", None, 1), ("a", None, 1), ("s", "t1_s", 1), ("b", "t1_s", 1), ("o", "t1_gone", 1), ("p", "o", 2), ("x", " ", 3)]
    t = tree(spark, rows)
    got = {x.id: x.mark for x in contradictions(t).collect()}
    assert got == {"s": "cycle", "b": "below_cycle", "o": "orphan", "p": "orphan", "x": "depth"}


def test_empty_and_clashing_columns(spark):
    assert tree(spark, []).count() == 0
    df = spark.createDataFrame([("a", None, 1, "q", "r", 3)], "id string, parent_id string, depth int, state string, path string, dist int")
    t = hierarchy(df, "id", comment_parent(F.col("parent_id")), "depth")
    assert [tuple(x) for x in t.select("id", "state", "path").collect()] == [("a", "top", "a")]


@pytest.mark.parametrize("seed", range(2))
def test_links_of_all_rows(spark, seed):
    from tallyforge.operators.hierarchy import links

    r = random.Random(seed)
    up = {f"n{i}": r.choice([None, f"n{r.randrange(45)}", f"n{r.randrange(45)}"]) for i in range(40)}
    up |= {"ring0": "ring4", "below0": "ring2", "below1": "below0", "self": "self"} | {f"ring{i}": f"ring{i - 1}" for i in range(1, 5)}
    want = set()
    for i in up:
        seen, cur, n = {i}, up[i], 1
        while cur in up and cur not in seen:
            want.add((cur, i, n))
            seen.add(cur)
            cur, n = up[cur], n + 1
    df = spark.createDataFrame([(i, p and f"t1_{p}", 1) for i, p in up.items()], SCHEMA)
    got = [tuple(x) for x in links(df, df.columns[0], comment_parent(F.col(df.columns[1]))).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ("below0", "below1", 1) in want and ("ring3", "below0", 5) in want
