import datetime as dt

import pytest

T0 = dt.datetime(2026, 1, 1)
POST = "post_id string, url string, subreddit string, title string, body string, author string, created_at timestamp, score long, comment_count long, source_surfaces array<string>, accepted_at timestamp"
BATCH = "row_id long, batch_no int, received_at timestamp, post_id string, url string, subreddit string, title string, body string, author string, created_at timestamp, score long, comment_count long, source_surfaces array<string>"
COMMENT = "post_id string, ord int, comment_id string, body string, url string, author string, parent_id string, depth int, score long, source_surface string, created_at timestamp, fetched_at timestamp"
WORD = "candidate_id long, run_id string, term string, normalized_term string, categories array<string>, extraction_methods array<string>, source_post_ids array<string>, authors array<string>, communities array<string>, discovery_score int, status string, found_at timestamp"
DOC = "doc_id long, text string, lang string, source string, n_chars long, community string, author string, published_at timestamp"
SCHEMAS = {"posts": POST, "post_batches": BATCH, "comments": COMMENT, "keyword_candidates": WORD, "documents": DOC, "mix_targets": "source string, target_share double, max_repeats int", "subject_areas": "subject string, description string", "subject_samples": "sample_id long, subject string, lang string, text string", "communities": "community_id string, name string, aliases array<string>, category string, status string, include_terms array<string>"}
#: Columns whose names operators might use inside.
CLASH = {"id": "'x'", "state": "1", "position": "'p'", "tokens": "array('q')", "term": "'t'", "full": "1L", "h": "'h'", "score2": "0", "b": "1", "r": "'r'", "x": "1", "start": "0L", "items": "array('i')", "pid": "'p'"}


def rows_of(schema, rows):
    names = [c.split()[0] for c in schema.split(", ")]
    return [tuple(r.get(n) for n in names) for r in rows]


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables (lists of dicts) to a data folder; tables not given are empty."""

    def make(extra=False, **tables):
        for name, schema in SCHEMAS.items():
            df = spark.createDataFrame(rows_of(schema, tables.get(name, [])), schema)
            if extra:
                from pyspark.sql import functions as F

                df = df.withColumns({k: F.expr(v) for k, v in CLASH.items() if k not in df.columns})
            df.coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
