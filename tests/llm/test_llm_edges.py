"""Every query on empty tables, and on nulls, blanks, repeats, very long texts and extra columns."""

import pytest

from tallyforge.llm import queries as Q

LONG = "word pump leak " * 20_000
ODD = [None, "", "   ", "\n\t", ".", "…" * 500, "." * 500 + "x", "!?" * 300 + "z", "\x00\x01", "👍", "((((", "@", "1" * 400, "-" * 400, "á" * 300, "&", LONG, "<|endoftext|>", "​", "same text", "same text"]


def odd_tables():
    posts = [{"post_id": f"t3_p{i}", "title": t, "body": t, "author": t, "subreddit": t, "source_surfaces": None} for i, t in enumerate(ODD)] + [{"post_id": "t3_z"}]
    batch = [{"row_id": i + 1, "batch_no": i % 3 + 1, "post_id": None if i % 2 else f" T3_N{i} ", "title": t, "body": t} for i, t in enumerate(ODD)] + [{}]
    comments = [{"comment_id": f"c{i}", "post_id": "t3_p1", "body": t, "author": t, "parent_id": t, "source_surface": t} for i, t in enumerate(ODD)] + [{"comment_id": "c1", "body": "again"}, {}]
    words = [{"candidate_id": i, "normalized_term": t if t is not LONG else "word pump " * 300, "authors": [t, None, t], "source_post_ids": [t, None, "t3_p1"]} for i, t in enumerate(ODD)] + [{"candidate_id": 99}, {"candidate_id": 100, "normalized_term": "a b", "authors": [], "source_post_ids": []}]
    docs = [{"doc_id": i, "text": t, "source": t if t is not LONG else "s", "lang": t} for i, t in enumerate(ODD)] + [{"doc_id": None}]
    return dict(posts=posts, post_batches=batch, comments=comments, keyword_candidates=words, documents=docs, mix_targets=[{"source": "s", "target_share": 0.5, "max_repeats": 2}, {}, {"source": "none", "target_share": 0.5, "max_repeats": 1}], subject_samples=[{"sample_id": 1, "subject": "a", "text": "pump leak. pump leak. pump word."}, {"sample_id": 2, "subject": None, "text": None}])


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, folder, name):
    rows = Q.QUERIES[name](spark, folder()).collect()
    assert rows == [] or (name == "p3_influence" and list(rows[0]) == [0, 0, 0, 0])


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_odd_rows(spark, folder, name):
    df = Q.QUERIES[name](spark, folder(extra=True, **odd_tables()))
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name == "p8_ids":
        got = {r.doc_id: r.ids for r in rows}
        assert len(rows) == len(ODD) + 1 and got[0] == [] and got[1] == [] and got[2] == [220, 220, 220] and got[None] == []
    if name in ("p2_found", "p3_found", "p7_found"):
        ids = {r[0] if name == "p2_found" else r.record_id for r in rows}
        assert not ids & {"c0", "c1", "c2", "c3", "t3_p0", "t3_z"}
    if name == "p10_found":
        assert not {r.doc_id for r in rows} & {0, 1, 2, 3, None}
    if name == "p7_scores":
        assert len(rows) == 2 * len(ODD) + 3


def test_oracle_has_only_known_names():
    assert set(Q.ORACLE) <= set(Q.QUERIES)
