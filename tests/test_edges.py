"""Every core query on empty tables and on rows with nulls, blanks, repeats and very long texts."""

import datetime as dt

import pytest

from tallyforge.plans import registry

SCHEMAS = {
    "posts": "post_id string, url string, subreddit string, title string, body string, author string, created_at timestamp, score long, comment_count long, source_surfaces array<string>, accepted_at timestamp",
    "post_batches": "row_id long, batch_no int, received_at timestamp, post_id string, url string, subreddit string, title string, body string, author string, created_at timestamp, score long, comment_count long, source_surfaces array<string>",
    "comments": "post_id string, ord int, comment_id string, body string, url string, author string, parent_id string, depth int, score long, source_surface string, created_at timestamp, fetched_at timestamp",
    "keyword_candidates": "candidate_id long, run_id string, term string, normalized_term string, categories array<string>, extraction_methods array<string>, source_post_ids array<string>, authors array<string>, communities array<string>, discovery_score int, status string, found_at timestamp",
    "communities": "community_id string, name string, aliases array<string>, category string, status string, include_terms array<string>",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, community string, author string, published_at timestamp",
    "mix_targets": "source string, target_share double, max_repeats int",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
}
LONG = "oil pump leak because of it " * 5_000
ODD = [None, "", "  ", "\n", "r/", "[deleted]", LONG, "x", "x", "☃ é"]
NOW = dt.datetime(2026, 6, 1)


def tables():
    full = lambda s: [c.split()[0] for c in s.split(", ")]
    rows = {
        "posts": [{"post_id": f"t3_p{i}", "title": t, "body": t, "author": t, "subreddit": t, "url": t, "created_at": NOW if i % 2 else None} for i, t in enumerate(ODD)] + [{}],
        "post_batches": [{"row_id": i, "batch_no": 1, "post_id": t, "title": t, "url": "/a", "subreddit": "x", "created_at": NOW} for i, t in enumerate(ODD)] + [{}],
        "comments": [{"comment_id": f"c{i}", "post_id": "t3_p1", "ord": i, "body": t, "author": t, "parent_id": t, "url": t} for i, t in enumerate(ODD)] + [{}],
        "keyword_candidates": [{"candidate_id": i, "term": t, "normalized_term": t, "authors": [t], "source_post_ids": [t, "t3_p1"], "communities": [t], "status": t, "run_id": "r", "found_at": NOW} for i, t in enumerate(ODD) if t is not LONG] + [{}],
        "communities": [{"name": "x", "aliases": None, "include_terms": [None, "a b"], "status": "approved"}, {}],
        "documents": [{"doc_id": i, "text": t, "source": t, "community": t} for i, t in enumerate(ODD)] + [{}],
        "mix_targets": [{}],
        "events": [{"event_id": 1, "ts": NOW, "user_id": None}, {"event_id": 2, "ts": NOW + dt.timedelta(days=1), "user_id": 1, "event_type": "a"}],
    }
    return {k: [tuple(r.get(c) for c in full(SCHEMAS[k])) for r in v] for k, v in rows.items()}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind, data in (("empty", {}), ("odd", tables())):
        d = tmp_path_factory.mktemp(kind)
        for name, schema in SCHEMAS.items():
            df = spark.createDataFrame(data.get(name, []), schema).coalesce(1)
            if name == "events":  # a stream reads one file
                df.write.parquet(f"{d}/tmp")
                (f,) = [p for p in (d / "tmp").iterdir() if p.suffix == ".parquet"]
                f.rename(d / "events.parquet")
            else:
                df.write.parquet(f"{d}/{name}.parquet")
        out[kind] = str(d)
    return out


ONE_ROW = {"q_analysis_counts", "q_select_communities", "q_run_coverage", "q_run_state", "q_run_counters", "q_source_status"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty(spark, folders, name):
    rows = registry.QUERIES[name](spark, folders["empty"]).collect()
    assert name in ONE_ROW or name in ("q_expansion", "q_metrics") or rows == []


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd(spark, folders, name):
    assert registry.QUERIES[name](spark, folders["odd"]).collect() is not None
