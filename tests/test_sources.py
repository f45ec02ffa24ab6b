import json

from pyspark.sql import functions as F

from tallyforge.functions.vocabulary import load_lexicon
from tallyforge.operators import expansion, listing
from tallyforge.operators import gate as G
from tallyforge.functions.vocabulary import Lexicon
from tallyforge.sources import listing as R
from tallyforge.sources import sinks as K


def test_listing_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "abc", "permalink": "/r/X/comments/abc/", "subreddit_name_prefixed": "r/X", "title": "T", "selftext": "B", "created_utc": 1750000000.0, "ups": 3, "num_comments": 2, "source_surfaces": ["hot", "new"]}, 5]))
    (tmp_path / "b.json").write_text(json.dumps({"data": {"children": [{"kind": "t3", "data": {"name": "t3_def", "url": "https://f.example/x", "subreddit": "Y", "title": "U", "created_at": "2025-06-15T00:00:00Z", "score": 1}}]}}))
    (tmp_path / "c.json").write_text("not json")
    raw = R.raw_listings(spark, str(tmp_path))
    assert raw.filter("raw IS NULL").count() == 2
    rows = {r.post_id: r for r in listing.accepted(listing.normalize(R.listing_rows(raw))).collect()}
    assert set(rows) == {"t3_abc", "t3_def"} and rows["t3_abc"].score == 3 and rows["t3_abc"].source_surfaces == ["hot", "new"] and rows["t3_def"].created_at.year == 2025


def test_thread_files(spark, tmp_path):
    (tmp_path / "abc.json").write_text(json.dumps({"comments": [{"id": "c1", "body": "x", "depth": "two", "score": 4}, "junk"]}))
    r = R.thread_rows(R.raw_threads(spark, str(tmp_path))).collect()
    assert len(r) == 1 and (r[0].post_id, r[0].comment_id, r[0].depth, r[0].score) == ("t3_abc", "c1", None, 4)


def test_report_and_csv(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"ranked_candidates": [{"source": "A", "id": "1", "title": "T", "score": 0, "upvotes": 7}], "items_by_source": {"b": [{"item_id": "2", "name": "N"}]}}))
    rows = {r.source: r for r in R.report_rows(spark, str(p)).collect()}
    assert rows["a"].engagement == 7 and rows["b"].title == "N"
    c = tmp_path / "c.csv"
    c.write_text("url,title\nhttps://x/r/y/comments/q1w2/z,T\n")
    assert R.candidate_list(spark, str(c)).first().post_id == "t3_q1w2"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b&c", ["x"])], "i int, s string, l array<string>")
    K.json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    K.sheets({"one": df}, str(tmp_path / "s"))
    K.workbook({"one": df}, str(tmp_path / "w.xlsx"))
    import zipfile

    z = zipfile.ZipFile(tmp_path / "w.xlsx")
    assert "a&lt;b&amp;c" in z.read("xl/worksheets/sheet1.xml").decode()
    assert "<b" not in K.page("t", {"one": df}).split("json")[1]
    K.snapshot(df, str(tmp_path / "v"), 1)
    K.snapshot(df.union(df), str(tmp_path / "v"), 2)
    assert K.latest_snapshot(spark, str(tmp_path / "v")).count() == 2


def test_lexicon_file(tmp_path):
    p = tmp_path / "l.yaml"
    p.write_text("communities:\n  - name: Trucks\ndictionaries:\n  products: [Oil Pan, oil pan, ' ']\nexclusions:\n  promotional_terms: [deal]\n")
    x = load_lexicon(str(p))
    assert x.products == ("oil pan",) and x.promotional == ("deal",) and x.approved_communities == ("trucks",)


def test_expansion_ends(spark):
    k = spark.createDataFrame([("a", "p1"), ("b", "p1"), ("b", "p2"), ("c", "p2"), ("z", "p9")], "term string, post_id string")
    terms, posts = expansion.expand(spark.createDataFrame([("A ",)], "term string"), lambda t: k.join(t, "term", "left_semi"), lambda p: k.join(p, "post_id", "left_semi"), rounds=9)
    assert {(r.term, r["round"]) for r in terms.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.post_id for r in posts.collect()} == {"p1", "p2"}
    terms, posts = expansion.expand(spark.createDataFrame([], "term string"), lambda t: k.join(t, "term", "left_semi"), lambda p: k.join(p, "post_id", "left_semi"))
    assert terms.count() == 0 and posts.count() == 0


def test_gate_cascade(spark):
    lex = Lexicon(products=("oil pan",), vehicle_terms=("ram",), approved_communities=("trucks",), off_domain=("bicycle",))
    rows = [("post", "1", "AutoModerator", "trucks", "t", "b", 1), ("post", "2", "x", "trucks", None, "[deleted]", 1), ("post", "3", "x", "trucks", None, "https://x.y/z", 1), ("post", "4", "x", "trucks", "Use code NOW", "b", 1), ("post", "5", "x", "trucks", None, "lol!", 1), ("post", "6", "x", "other", "plain", "words here", 1), ("post", "7", "x", "trucks", "My oil pan leaked", "I replaced it with a kit and torque spec last winter", 90), ("post", "8", "y", "trucks", "My oil pan leaked", "I replaced it with a kit and torque spec last winter!", 0), ("post", "9", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "record_type string, ord string, author string, community string, title string, body string, score long")
    got = {r.ord: (r.reason, r.role) for r in G.scored(G.reasons(G.flags(df, lex))).collect()}
    assert [got[str(i)][0] for i in range(1, 10)] == ["bot_author", "deleted_or_removed", "url_only", "promotion", "banter", "missing_context", None, "duplicate", "missing_context"]
    assert got["7"][1] == "direct_experience" and got["8"][1] == "noise"
