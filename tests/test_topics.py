import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyforge.operators import claims as C
from tallyforge.operators import topics as P

AS_OF = dt.datetime(2026, 6, 15)


def fold(members, evidence, most=3):
    """Proposals one after the other."""
    posts, refs = defaultdict(list), defaultdict(list)
    for c, p, o, x in members:
        posts[c, o, p].append(x)
    for p, x, ok in evidence:
        refs[p].append((x, ok))
    used, out = defaultdict(int), {}
    for c, _, p in sorted(posts):
        free = {x for x in posts[c, _, p] if used[c, x] < most}
        if not free:
            out[p] = "no_eligible_posts"
        elif not refs[p] or any(not ok or x not in free for x, ok in refs[p]):
            out[p] = "invalid_evidence"
        else:
            out[p] = "accepted"
            for x in free:
                used[c, x] += 1
    return out


def test_accept_like_a_fold(spark):
    for seed in range(3):
        r = random.Random(seed)
        members = [(r.choice("xy"), p, p, f"t{r.randrange(8)}") for p in range(60) for _ in range(r.randint(1, 3))]
        first = {}
        members = sorted({(first.setdefault(p, c), p, o, x) for c, p, o, x in members})
        evidence = [(p, r.choice([x for c, q, o, x in members if q == p] + ["t99"] * (r.random() < 0.1)), r.random() < 0.95) for p in range(60) for _ in range(r.randint(0, 2))]
        m = spark.createDataFrame(members, "community string, prop_id long, ord long, post_id string")
        e = spark.createDataFrame(evidence, "prop_id long, post_id string, ok boolean")
        got = {x.prop_id: x.decision for x in P.accept(m, e).collect()}
        assert got == fold(members, evidence)


def test_accept_takes_no_more_stages_for_long_chains(spark, monkeypatch):
    """Proposals that wait for one another, however many: one written stage, the decisions of the fold; a proposal's rows in several batches."""
    r = random.Random(5)
    members = [(r.choice("xy") if p % 9 else "z", p, p, f"t{r.randrange(60)}") for p in range(500)]
    members = sorted({(c, p, o, x) for c, p, o, y in members for x in [y] + [f"t{r.randrange(60)}" for _ in range(r.randint(0, 5))]})
    evidence = [(p, x, r.random() < 0.97) for c, p, o, x in members if r.random() < 0.3]
    stages, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: (stages.append(name), write(df, name))[1])
    m = spark.createDataFrame(members, "community string, prop_id long, ord long, post_id string").repartition(5)
    e = spark.createDataFrame(evidence, "prop_id long, post_id string, ok boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = P.accept(m, e).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = fold(members, evidence)
    assert {x.prop_id: x.decision for x in rows} == want and len(rows) == len(want) and set(want.values()) == {"accepted", "no_eligible_posts", "invalid_evidence"}
    assert len(stages) == 1


def counted(spark, days, people=0):
    posts = spark.createDataFrame([(f"p{i}", f"a{i}", 1, AS_OF - dt.timedelta(days=d)) for i, d in enumerate(days)], "post_id string, author string, score long, created_at timestamp")
    tp = spark.createDataFrame([("c", "k", f"p{i}") for i in range(len(days))], "community string, key string, post_id string")
    comments = spark.createDataFrame([(f"p{i % len(days)}", f"c{i}") for i in range(people)], "post_id string, comment_id string")
    who = spark.createDataFrame([(f"p{i % len(days)}", f"w{i}") for i in range(people)], "post_id string, name string")
    return P.counts(tp, posts, comments, who, AS_OF)


def test_trend_and_status(spark):
    assert [(r.status, r.trend) for r in [counted(spark, d).first() for d in ([1, 2, 3], [1, 2, 40], [1, 40, 50, 60, 70], [40, 50, 60], [100, 101, 102])]] == [("formal", "new"), ("formal", "rising"), ("formal", "falling"), ("formal", "falling"), ("formal", "stable")]
    assert counted(spark, [1, 2], people=10).first().status == "formal"
    assert counted(spark, [1, 2], people=9).first().status == "weak_signal"


def test_heat_of_three_posts_without_commenters_is_80(spark):
    assert P.heat(counted(spark, [1, 2, 3])).first().heat == 80.0


def test_claims(spark):
    df = spark.createDataFrame([("p", "e", "a", "My pump failed because it ran dry for weeks. There is no leak at all. I bought a kit last week."), ("p", None, "a", "My pump failed again today."), ("q", "f", None, None)], "post_id string, evidence_id string, author string, text string")
    got = {(r.field, r.source_text): (r.status, r.severity, r.consequence) for r in C.distinct(C.from_sentences(df)).collect()}
    assert got["pain", "My pump failed because it ran dry for weeks."] == ("fact", "high", "it ran dry for weeks.")
    assert ("pain", "There is no leak at all.") not in got
    assert got["current_solution", "I bought a kit last week."][0] == "fact"
    c = C.distinct(C.from_sentences(df))
    assert {r.text for r in c.filter("field = 'pain'").collect()} == {"用户报告故障、损坏或失效"} and {r.text for r in c.filter("field = 'current_solution'").collect()} == {"用户已尝试：a kit last week."}
    agg = C.aggregate(c.withColumn("topic", F.lit("t")), ["topic"])
    assert C.opportunities(agg, ["topic"]).count() == 0


def test_checked_citations(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("v", ["a", "b"], "fact", ["a", "b", "c"]), ("v", ["a", "z"], "fact", ["a"]), ("v", [], "fact", ["a"]), ("v", ["a"], "guess", ["a"])], "v string, ids array<string>, s string, known array<string>")
    got = [r.f.asDict() for r in df.select(C.checked(F.col("v"), F.col("ids"), F.col("s"), F.col("known")).alias("f")).collect()]
    assert got[0] == {"value": "v", "evidence_ids": ["a", "b"], "status": "fact"} and all(g == {"value": "unknown", "evidence_ids": [], "status": "unknown"} for g in got[1:])
    m = spark.sql("SELECT array('a') AS ids, array('u') AS urls, map('a', 'u') AS known")
    assert m.select(C.cited(F.col("ids"), F.col("urls"), F.col("known"))).first()[0]


def test_opportunity_of_each_topic(spark):
    """A gap that two authors tell in two posts, where two authors tell a pain; told differently, it is one gap."""
    say = [("p1", "ann", "I had to modify the bracket. My pump has a leak."), ("p2", "Bob", "We had to modify the bracket. The hose has a leak now."), ("p3", "bob", "It had no instructions in the box.")]
    df = spark.createDataFrame([(p, f"e{i}", a, t) for i, (p, a, t) in enumerate(say)], "post_id string, evidence_id string, author string, text string")
    c = C.distinct(C.from_sentences(df))
    two = c.withColumn("topic", F.lit("x")).unionByName(c.filter("post_id <> 'p2'").withColumn("topic", F.lit("y")))
    got = [tuple(r) for r in C.opportunities(C.aggregate(two, ["topic"]), ["topic"]).collect()]
    assert got == [("x", "用户指出方案缺口：the bracket.", 2, 2, 2)]
    known = spark.createDataFrame([("p1", "e0", "https://a"), ("p2", "e1", ""), ("p9", "e0", "https://b")], "post_id string, evidence_id string, url string")
    assert [tuple(r) for r in C.evidence(c, known).collect()] == [("p1", "e0", "https://a")]


def test_references_and_texts_of_mixed_shapes(spark):
    from tallyforge.operators import analysis as A

    rows = [('{"text": " said ", "evidence": [{"post_id": "p", "evidence_id": "e"}, "q:f", "g", {"post_id": "p"}, 3]}',), ('{"scene": "road", "goal": "tow"}',), ('"plain"',), ('["a:b:c", " "]',), (None,)]
    x = spark.createDataFrame(rows, "raw string").select(F.try_parse_json("raw").alias("v"))
    got = [(r.t, [tuple(y) for y in r.r or []]) for r in x.select(A.claim_text(F.col("v")).alias("t"), A.references(F.col("v")).alias("r")).collect()]
    assert got[0] == ("said", [("p", "e"), ("q", "f"), ("", "g"), ("", "3")]) and got[1][0] == "场景：road；目标：tow"
    assert got[2][0] == "plain" and got[3][1] == [("a", "b:c")] and got[4] == ("", [])
