"""Queries over the reply trees of comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.hierarchy import comment_parent, contradictions, descendants, hierarchy, links
from tallyforge.sources.tables import table


def _tree(spark: SparkSession, folder: str, with_path: bool) -> DataFrame:
    return hierarchy(table(spark, folder, "comments"), "comment_id", comment_parent(F.col("parent_id")), "depth", with_path)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """comment_id, mark of every comment whose place is impossible or contradicts the stored depth."""
    return contradictions(_tree(spark, folder, False)).select(F.col("id").alias("comment_id"), "mark")


def p6_paths(spark: SparkSession, folder: str) -> DataFrame:
    """path, depth, root and state of every comment."""
    return _tree(spark, folder, True).select(F.col("id").alias("comment_id"), "state", F.col("root").alias("root_id"), "true_depth", "path")


def p6_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Number of descendants of every comment that is neither in nor below a cycle; p6_links has those of all."""
    return descendants(_tree(spark, folder, True)).select(F.col("id").alias("comment_id"), "descendants")


def p6_links(spark: SparkSession, folder: str) -> DataFrame:
    """ancestor, descendant, distance: all descendants of every comment, in and below cycles too."""
    return links(table(spark, folder, "comments"), "comment_id", comment_parent(F.col("parent_id")))


QUERIES = {"p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants, "p6_links": p6_links}

_WALK = """
WITH RECURSIVE node AS (
  SELECT comment_id AS id, min(CASE WHEN parent_id IS NULL OR trim(parent_id) = '' OR lower(trim(parent_id)) LIKE 't3\\_%' ESCAPE '\\' THEN NULL
    ELSE regexp_replace(trim(parent_id), '^[tT]1_', '') END) AS parent, min(depth) AS stored
  FROM comments WHERE comment_id IS NOT NULL GROUP BY 1),
reach(id, anc) AS (
  SELECT id, parent FROM node WHERE parent IS NOT NULL
  UNION
  SELECT r.id, n.parent FROM reach r JOIN node n ON n.id = r.anc WHERE n.parent IS NOT NULL),
own AS (SELECT id FROM reach WHERE id = anc),
missing AS (SELECT DISTINCT r.id FROM reach r WHERE r.anc NOT IN (SELECT id FROM node)),
below AS (SELECT DISTINCT r.id FROM reach r JOIN own o ON o.id = r.anc),
level AS (SELECT n.id, count(r.anc) FILTER (WHERE r.anc IN (SELECT id FROM node)) + 1 AS true_depth FROM node n LEFT JOIN reach r ON r.id = n.id GROUP BY 1),
state AS (SELECT n.id, n.stored, CASE WHEN n.id IN (SELECT id FROM own) THEN 'cycle' WHEN n.id IN (SELECT id FROM below) THEN 'below_cycle'
  WHEN n.id IN (SELECT id FROM missing) THEN 'orphan' ELSE 'top' END AS state, l.true_depth
  FROM node n JOIN level l USING (id))
"""

ORACLE = {
    "p6_found": _WALK
    + """SELECT id AS comment_id, CASE WHEN state <> 'top' THEN state ELSE 'depth' END AS mark FROM state
WHERE state <> 'top' OR stored IS NULL OR stored <> true_depth""",
    "p6_descendants": _WALK
    + """SELECT s.id AS comment_id, count(r.id) AS descendants FROM state s LEFT JOIN reach r ON r.anc = s.id
WHERE s.state IN ('top', 'orphan') GROUP BY 1""",
}
