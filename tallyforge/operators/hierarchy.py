"""Parent-child rows to full hierarchies by pointer doubling.

Every row starts with a pointer to its parent at distance 1.  A round joins the unresolved rows with the rows
their pointers name: a resolved target gives root, depth and path, an unresolved one doubles the jump.  After k
rounds every row of depth up to 2**k is resolved.  A round that resolves nothing ends the loop: were any row left
with a finite depth, its ancestors of all smaller depths would have been resolved in that round.  What is left leads
into cycles; the members of the cycles are the stable image of the pointers among the rows left.

Defined cases
    * empty table: empty result;
    * null id: the row is not a node and is left out;
    * repeated id: one node; the delivery first in (parent form, depth) order that is not null is kept;
    * null, blank or prefixed-root parent: a top-level row of depth 1;
    * parent that is no row: ``orphan`` for the row and everything below it;
    * any other column of the input is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import skew
from tallyforge.operators.buckets import Buckets
from tallyforge.session import written

SEP = "/"
MAX_ROUNDS = 64


def comment_parent(parent: Column) -> Column:
    """The parent comment's id without its kind prefix; null where the row is top-level."""
    p = F.trim(parent)
    return F.when(p.isNull() | (p == "") | F.lower(p).startswith("t3_"), None).otherwise(F.regexp_replace(p, "^[tT]1_", ""))


def nodes(df: DataFrame, node: str, parent: Column, depth: str | None) -> DataFrame:
    """One row per id: id, parent (null: top-level), stored depth.  Second deliveries are merged before anything is shuffled."""
    one = df.select(F.col(node).alias("id"), parent.alias("parent"), (F.col(depth) if depth else F.lit(None)).cast("int").alias("stored"))
    return one.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent").alias("parent"), F.min("stored").alias("stored"))


def hierarchy(df: DataFrame, node: str, parent: Column, depth: str | None = None, with_path: bool = True) -> DataFrame:
    """id, stored, state ('top', 'orphan', 'cycle', 'below_cycle'), root, true_depth, path.

    ``path`` is root/.../id, from the topmost row that exists; ``root``, ``true_depth`` and ``path`` are null in and
    below cycles.  ``true_depth`` of an orphan counts from the topmost row that exists.  ``with_path`` false leaves
    the column out of every round.

    Rows are written bucketed by id, the resolved ones once and for all: a round moves only the pointers that are left,
    to the rows they name and back.  Rows that point where one in a hundred of them does stay where they are.
    """
    spark = df.sparkSession
    more = ["path"] if with_path else []
    path_type = ", path string" if with_path else ""
    base = Buckets(spark, "nodes", "id string, parent string, stored int", "id")
    base.append(nodes(df, node, parent, depth))
    rows = base.read()
    # Round 0: a parent that is no row ends the chain there.
    known = rows.select(F.col("id").alias("pid"))
    linked = skew.join(rows.select("id", "stored", "parent"), known, "parent", "pid", skew.hot_keys(rows, "parent"), how="left", nulls=True)
    there = F.col("pid").isNotNull()
    step = linked.select("id", "stored", F.when(there, F.col("parent")).alias("ptr"), F.when(F.col("parent").isNull(), F.lit("top")).when(~there, F.lit("orphan")).alias("state"), F.lit(None).cast("string").alias("root"), F.lit(1).alias("dist"), *([F.col("id").alias("path")] if with_path else []))
    done = Buckets(spark, "resolved", "id string, stored int, state string, root string, true_depth int" + path_type, "id")
    held, left = base, None
    for _ in range(MAX_ROUNDS):
        now = Buckets(spark, "pointers", "id string, stored int, ptr string, state string, root string, dist int" + path_type, "id")
        now.append(step)
        held.close(files=True)
        held, moved = now, now.read()
        done.append(moved.filter("state IS NOT NULL").select("id", "stored", "state", F.coalesce("root", "id").alias("root"), F.col("dist").alias("true_depth"), *more), placed=True)
        active = moved.filter("state IS NULL")
        n, hot = skew.counted(active, "ptr")
        if not n or n == left:
            left = n
            break
        left = n
        own = active.select("id", "stored", "ptr", "dist", *more)
        ended = done.read().select(F.col("id").alias("d_id"), F.col("state").alias("d_state"), F.col("root").alias("d_root"), F.col("true_depth").alias("d_dist"), *[F.col(c).alias(f"d_{c}") for c in more])
        on = active.select(F.col("id").alias("a_id"), F.col("ptr").alias("a_ptr"), F.col("dist").alias("a_dist"), *[F.col(c).alias(f"a_{c}") for c in more])
        is_hot = F.col("ptr").isin(hot)
        # Both joins are on the pointer, so it moves once; of hot pointers' targets there are fewer than skew.SHARE.
        parts = [own.filter(~is_hot).join(ended, F.col("ptr") == F.col("d_id"), "left").join(on, F.col("ptr") == F.col("a_id"), "left")] if hot else [own.join(ended, F.col("ptr") == F.col("d_id"), "left").join(on, F.col("ptr") == F.col("a_id"), "left")]
        if hot:
            parts.append(own.filter(is_hot).join(F.broadcast(ended.filter(F.col("d_id").isin(hot))), F.col("ptr") == F.col("d_id"), "left").join(F.broadcast(on.filter(F.col("a_id").isin(hot))), F.col("ptr") == F.col("a_id"), "left"))
        step = None
        for part in parts:
            one = part.select("id", "stored", F.col("a_ptr").alias("ptr"), F.col("d_state").alias("state"), F.col("d_root").alias("root"), (F.col("dist") + F.coalesce("d_dist", "a_dist")).alias("dist"), *([F.concat(F.coalesce("d_path", "a_path"), F.lit(SEP), F.col("path")).alias("path")] if with_path else []))
            step = one if step is None else step.unionByName(one)
    resolved = done.plain()
    done.close()
    tail = _cycles(held.read().filter("state IS NULL").select("id", "stored", "ptr")) if left else None
    held.close(files=True)
    return resolved if tail is None else resolved.unionByName(tail, allowMissingColumns=True)


def _cycles(active: DataFrame) -> DataFrame:
    """State of the rows that lead into cycles.  The image of 2**k parent steps shrinks to the cycles' members; once a doubling leaves its size unchanged it stays."""
    jump = written(active.select("id", "ptr"), "jump")
    size = jump.select("ptr").distinct().count()
    for _ in range(MAX_ROUNDS):
        t = jump.select(F.col("id").alias("t_id"), F.col("ptr").alias("t_ptr"))
        jump = written(jump.join(t, jump.ptr == t.t_id).select("id", F.col("t_ptr").alias("ptr")), "jump")
        now = jump.select("ptr").distinct().count()
        if now == size:
            break
        size = now
    members = jump.select(F.col("ptr").alias("m")).distinct()
    out = active.select("id", "stored").join(members, active.id == members.m, "left")
    return written(out.select("id", "stored", F.when(F.col("m").isNotNull(), F.lit("cycle")).otherwise(F.lit("below_cycle")).alias("state")), "cycles")


def contradictions(tree: DataFrame) -> DataFrame:
    """id, mark: 'cycle', 'below_cycle', 'orphan', or 'depth' where the stored depth is null or not the true one."""
    wrong = F.col("stored").isNull() | (F.col("stored") != F.col("true_depth"))
    mark = F.when(F.col("state") != "top", F.col("state")).when(wrong, F.lit("depth"))
    return tree.select("id", mark.alias("mark")).filter(F.col("mark").isNotNull())


def descendants(tree: DataFrame, links: bool = False) -> DataFrame:
    """For every row with a path, the number of rows below it (``links`` true: the pairs ancestor, descendant, distance).

    A row is a descendant of each id of its own path, so the pairs come from exploding the path and the count from
    one aggregation that is combined on the map side.
    """
    ids = F.split(F.col("path"), SEP)
    pairs = tree.filter(F.col("path").isNotNull()).select(F.col("id").alias("descendant"), F.size(ids).alias("n"), F.posexplode(ids).alias("at", "ancestor"))
    if links:
        return pairs.select("ancestor", "descendant", (F.col("n") - 1 - F.col("at")).cast("int").alias("distance"))
    return pairs.groupBy(F.col("ancestor").alias("id")).agg((F.count("*") - 1).alias("descendants"))


def links(df: DataFrame, node: str, parent: Column) -> DataFrame:
    """ancestor, descendant, distance (the fewest steps up) of every row and each other row above it, in and below cycles too.

    Members of a cycle are above each other and above all that leads into it.  A row below a cycle gets the rows up to
    the member where its chain enters from a path that starts there, and the other members from their places in the ring.
    """
    base = written(nodes(df, node, parent, None).select("id", "parent"), "links")
    tree = hierarchy(base, "id", F.col("parent"))
    above = lambda t: descendants(t, links=True).filter(F.col("distance") > 0)
    off = written(tree.filter(F.col("state").isin("cycle", "below_cycle")).select("id", "state").join(base, "id"), "off")
    if off.isEmpty():
        return above(tree)
    ring = _rings(off.filter(F.col("state") == "cycle").select("id", "parent"))
    below = hierarchy(off.select("id", F.when(F.col("state") == "below_cycle", F.col("parent")).alias("parent")), "id", F.col("parent"))
    # A row and the member where its chain enters the cycle: itself, for a member.
    entered = below.select(F.col("id").alias("descendant"), F.col("root").alias("id"), (F.col("true_depth") - 1).alias("steps")).join(ring, "id").select("descendant", "steps", "ring", F.col("at").alias("entry"), "length")
    other = entered.join(ring.select("ring", "at", F.col("id").alias("ancestor")), "ring").filter(F.col("at") != F.col("entry"))
    around = other.select("ancestor", "descendant", (F.col("steps") + F.pmod(F.col("entry") - F.col("at"), F.col("length"))).cast("int").alias("distance"))
    return above(tree).unionByName(above(below)).unionByName(around)


def _rings(members: DataFrame) -> DataFrame:
    """id, ring (the cycle's least id), at (place in the ring, a parent one before its child), length of every cycle member."""
    jump = written(members.select("id", F.col("parent").alias("ptr"), F.least("id", "parent").alias("low")), "ring")
    for _ in range(MAX_ROUNDS):
        t = jump.select(F.col("id").alias("t_id"), F.col("ptr").alias("t_ptr"), F.col("low").alias("t_low"))
        step = jump.join(t, jump.ptr == t.t_id).select("id", F.col("t_ptr").alias("ptr"), F.least("low", "t_low").alias("low"), (F.col("t_low") < F.col("low")).alias("moved"))
        jump = written(step, "ring")
        if jump.filter("moved").isEmpty():
            break
    cut = members.join(jump.select("id", "low"), "id").select("id", F.when(F.col("id") != F.col("low"), F.col("parent")).alias("parent"))
    placed = hierarchy(cut, "id", F.col("parent"), with_path=False).select("id", F.col("root").alias("ring"), F.col("true_depth").alias("at"))
    return placed.join(placed.groupBy("ring").agg(F.max("at").alias("length")), "ring")
