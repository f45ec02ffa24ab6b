import datetime as dt
import random

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import listing as L

SCHEMA = "post_id string, url string, subreddit string, title string, body string, author string, created_at timestamp, score long, comment_count long, source_surfaces array<string>"
AS_OF = dt.datetime(2026, 6, 15)


def post(i, **k):
    base = {"post_id": f"t3_{i}", "url": f"/r/x/comments/{i}/", "subreddit": "r/Trucks", "title": f"  title  {i} ", "body": "text", "author": "a", "created_at": AS_OF - dt.timedelta(days=1), "score": 1, "comment_count": 0, "source_surfaces": ["new"]} | k
    return tuple(base.values())


def listing(spark, rows):
    return L.normalize(spark.createDataFrame(rows, SCHEMA), "https://forum.example")


def test_normalize(spark):
    r = listing(spark, [post("A1 ", url="HTTP://Forum.Example/r/x/?q=1#f", score=-3, author=" ", source_surfaces=None)]).first()
    assert (r.post_id, r.url, r.subreddit, r.title, r.author, r.score, r.source_surfaces, r.reject) == ("t3_a1", "https://forum.example/r/x", "Trucks", "title A1", None, 0, [], None)


def test_rejects_are_kept_apart(spark):
    x = listing(spark, [post("a"), post("b", title=None), post("c", url=" "), post("d", created_at=None)])
    assert sorted((r.reject or "") for r in x.collect()) == ["", "missing_time", "missing_title", "missing_url"]
    assert L.accepted(x).count() == 1


def test_merge_takes_longest_body_and_highest_counts(spark):
    x = listing(spark, [post("a", body="long text", score=2, source_surfaces=["hot"]), post("a", body="x", score=8, comment_count=4, source_surfaces=["new", "hot"])])
    r = L.dedup(L.accepted(x)).first()
    assert (r.body, r.score, r.comment_count, r.source_surfaces) == ("long text", 8, 4, ["hot", "new"])


def test_two_ids_of_one_url(spark):
    x = listing(spark, [post("a", url="/same", score=1), post("b", url="/same/", score=9)])
    r = L.dedup(L.accepted(x)).collect()
    assert len(r) == 1 and r[0].post_id == "t3_b" and r[0].score == 9


def test_merge_does_not_depend_on_order(spark):
    r = random.Random(1)
    rows = [post(r.choice("abc"), body=r.choice(["x", "yy", "zz"]), score=r.randrange(4), url=f"/{r.choice('uv')}", source_surfaces=[r.choice(["hot", "new"])]) for _ in range(40)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = sorted(map(repr, L.dedup(L.accepted(listing(spark, rows).repartition(seed + 1))).collect()))
        assert want in (None, got)
        want = got


def test_window_borders(spark):
    ages = {"c": dt.timedelta(days=30), "b": dt.timedelta(days=90), "old": dt.timedelta(days=90, seconds=1), "future": -dt.timedelta(seconds=1)}
    df = spark.createDataFrame([(k, AS_OF - v) for k, v in ages.items()], "k string, t timestamp")
    got = {r.k: r.w for r in df.select("k", L.window_label(F.col("t"), AS_OF).alias("w")).collect()}
    assert got == {"c": "current", "b": "baseline", "old": None, "future": None}


def ranked(spark, rows):
    x = spark.createDataFrame(rows, "community string, post_id string, window string, score long, comment_count long, created_at timestamp, title string, body string, source_surfaces array<string>")
    return x.withColumn("priority", L.priority(F.col("window"), F.col("score"), F.col("comment_count")))


def test_current_beats_loud_baseline_and_ties_go_by_id(spark):
    rows = [("x", "b", "current", 1, 0, AS_OF, "", "", []), ("x", "a", "current", 1, 0, AS_OF, "", "", []), ("x", "z", "baseline", 900, 900, AS_OF, "", "", [])]
    assert [r.post_id for r in L.top_k(ranked(spark, rows), 2).orderBy("rank").collect()] == ["a", "b"]


def brute_stratified(rows, k):
    import re

    def key(r):
        return (-((6000 if r[2] == "current" else 0) + min(r[3], 100) * 30 + min(r[4], 100) * 10), -r[3], -r[4], r[1])

    order = sorted(rows, key=key)
    chosen = []

    def take(xs, n):
        for r in xs:
            if len(chosen) >= k or n <= 0:
                return
            if r not in chosen:
                chosen.append(r)
                n -= 1

    take([r for r in order if "controversial" in r[8]], max(1, round(k * 0.1)))
    months = {}
    for r in order:
        months.setdefault(r[5].strftime("%Y-%m"), []).append(r)
    turn, i = [], 0
    while any(i < len(v) for v in months.values()):
        turn += [months[m][i] for m in sorted(months, reverse=True) if i < len(months[m])]
        i += 1
    take(turn, max(1, round(k * 0.25)))
    words = lambda r: len(re.findall(L.SPECIFIC.removeprefix("(?U)"), (r[6] + " " + r[7]).lower()))
    take(sorted(order, key=lambda r: (-words(r), *key(r))), max(1, round(k * 0.15)))
    take(order, max(0, round(k * 0.5)))
    take(order, k)
    return [r[1] for r in chosen]


def test_stratified_like_brute_force(spark):
    r = random.Random(3)
    rows = [("x", f"p{i:03}", r.choice(["current", "baseline"]), r.randrange(50), r.randrange(20), AS_OF - dt.timedelta(days=r.randrange(200)), r.choice(["leak and fail", "help", "words"]), "body", [r.choice(["hot", "controversial", "new"])]) for i in range(80)]
    for k in (3, 8, 20):
        got = [x.post_id for x in L.stratified(ranked(spark, rows), k).orderBy("pick").collect()]
        assert got == brute_stratified(rows, k)


def test_balanced_keeps_the_oldest_new_one(spark):
    rows = [("x", f"p{i:02}", "current", 0, 0, AS_OF - dt.timedelta(days=i), "", "", ["new"]) for i in range(20)] + [("x", f"t{i}", "current", 0, 0, AS_OF, "", "", ["top_year"]) for i in range(5)]
    got = {r.post_id for r in L.balanced(ranked(spark, rows), 8).collect()}
    assert "p19" in got and len(got) == 8 and any(p.startswith("t") for p in got)


def test_empty_listing(spark):
    x = listing(spark, [])
    assert L.dedup(L.accepted(x)).count() == 0
    assert L.run_status(L.coverage(L.accepted(x), ["subreddit"], dt.date(2026, 1, 1), F.lit(None).cast("string"))).first().status == "partial"


def test_text_functions(spark):
    df = spark.createDataFrame([("Oil-Pan  KIT 2 x", "One is long. Two is - long too! no"), (None, None)], "a string, b string")
    r = df.select(T.keyword_norm(F.col("a")), T.collapse(F.col("a")), T.ngrams(T.keyword_tokens(F.col("a")), 2, 2), T.sentences(F.col("b")), T.slug(F.col("a"), 5), T.evidence_norm(F.col("a"))).collect()
    assert r[0][0] == "oil pan kit 2 x" and r[0][1] == "Oil-Pan KIT 2 x" and r[0][2][0] == "oil pan"
    assert r[0][3] == ["One is long.", "Two is - long too!"] and r[0][4] == "oil_p" and r[0][5] == "oil pan kit 2 x"
    assert r[1][0] == "" and r[1][2] == []
