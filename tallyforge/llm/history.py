"""New batches against everything accepted before, by hashes in bucketed tables that outlast a run.

A record repeats an accepted one if it has the same id, or if its title says the same.  A title is its content words:
without the order of clauses, case, spacing, hyphens, articles, function words, greetings and thousands separators.  A
word that is not common is taken for a misspelt common one if it is one letter off (two in long ones); one that is near
no common word identifies what is spoken of, as figures do.

The store keeps of each title

* the hash of its content with misspelt words put right; copies of such a title are full copies;
* further hashes where that is no certain matter (short words, or more than one common word near);
* a hash for each paragraph, a clause or one of five bins of words (which outlast a lost comma), together with all
  that identifies.  Two titles of which at least ``COVER`` of the paragraphs are shared are compared word by word.

Its tables are bucketed by id, content, further hash and paragraph, and lie in a folder: ``Store.open`` of a later
session goes on with them, so that a new batch is hashed alone and met with bucket-local semi-joins; accepted rows are
appended.  The common words are counted once, over the first rows that come in, and kept with the store, so hashes
never depend on the batch.

No group of titles is paired with itself: full copies are one row each, and where more than ``HOT`` of them share a
paragraph, its key is refined by what two near words have in common, without loss (see ``_variants``).

Batch rows are settled in their order: a row repeats if an accepted earlier row, or one of the history, has its id or
says the same, and is accepted if no unsettled earlier row could still decide.  Of several matches the history's full
copies come first, then its misspelt ones (by id), then the batches' rows in their order.

Defined cases: null and blank ids and titles match nothing; a row with neither is accepted; rows that repeat a row which
itself was no new post are held against the accepted one only; an empty batch or history is allowed; a batch that is
appended twice changes nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, product

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import skew
from tallyforge.operators.buckets import Buckets
from tallyforge.session import drop_path, exists, new_path, written, written_at

#: Words in at least this share of the titles are common (at most the mean number of words / COMMON of them).
COMMON, LEAST = 0.0005, 3
#: Share of the paragraphs of the title that has fewer; contents that share a paragraph before its key is refined.
COVER, HOT = 0.4, 256
#: Shortest word that is put right before it is hashed, and that may be misspelt at all.
SURE, SHORTEST = 5, 4
#: Words that change nothing in what a title says.
EMPTY = frozenset("the a an my our your his her their its it this is are was were be has have had do does did not will still and or of on in at to for with w by i we as from that yet after since when while every each right just already then so".split())
NOISE = frozenset("solved update updated help please plz pls x post xpost crosspost repost reposted again pic pics photos inside thanks thank thx thoughts advice urgent fixed edit edited amp diesel anyone ideas fyi ps tia".split())
_TOKEN = re.compile(r"[^\W_]+")
_CLAUSE = re.compile(r"\s*[,;|:()\[\]]\s*|\s+[-–—]+\s+")
#: A figure with thousands separators of one kind; a number that stands before one is no part of it.
_FIGURE = re.compile(r"(?<!\d)\d{1,3}([,.' ])\d{3}(?:\1\d{3})*(?!\d)(?![,.' ]\d{3}(?!\d))")
_NAME = re.compile(r"(?<!\w)[^\W\d_]+(?:-[^\W\d_]+)+(?!\w)")


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)


def word_counts(titles: DataFrame, title: str) -> DataFrame:
    """word, n: in how many titles each word occurs."""
    return titles.filter(F.col(title).isNotNull()).select(F.explode(F.array_distinct(F.split(F.lower(title), r"(?U)[^\p{L}\p{N}]+"))).alias("word")).filter(F.length("word") > 0).groupBy("word").agg(F.count("*").alias("n"))


def common_words(titles: DataFrame, title: str) -> frozenset[str]:
    """The words that at least COMMON of the titles hold."""
    n = titles.filter(F.col(title).isNotNull()).count()
    return frozenset(r["word"] for r in word_counts(titles, title).filter(F.col("n") >= max(LEAST, COMMON * n)).select("word").collect())


def near(a: str, b: str) -> bool:
    """One letter added, dropped, changed or two swapped; two of these in words of nine letters or more."""
    most = 2 if min(len(a), len(b)) >= 9 else 1
    if abs(len(a) - len(b)) > most:
        return False
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1] <= most


def _variants(w: str) -> set[str]:
    """The word with up to one letter dropped, two of nine letters or more (and eight, which may have lost one): near words share one."""
    out = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
    if len(w) >= 8:
        out |= {w[:i] + w[i + 1 : j] + w[j + 1 :] for i, j in combinations(range(len(w)), 2)}
    return out


class Speller:
    """Which common words a word may stand for."""

    LIMIT = 500_000

    def __init__(self, common: frozenset[str]):
        self.common = common
        self.by: dict[str, list[str]] = defaultdict(list)
        for v in sorted(common):
            if len(v) >= SHORTEST and v.isalpha():
                for x in _variants(v):
                    self.by[x].append(v)
        self.seen: dict[str, tuple[str, ...]] = {}

    def meant(self, w: str) -> tuple[str, ...]:
        """Near common words of a word that is not common itself."""
        if w in self.common or len(w) < SHORTEST or not w.isalpha():
            return ()
        got = self.seen.get(w)
        if got is None:
            if len(self.seen) > self.LIMIT:
                self.seen.clear()
            got = self.seen[w] = tuple(sorted({v for x in _variants(w) for v in self.by.get(x, ()) if near(w, v)}))
        return got


def _words(clause: str) -> list[str]:
    return [w for w in _TOKEN.findall(clause) if w not in EMPTY and w not in NOISE]


def fingerprint(title: str | None, speller: Speller) -> tuple[int, list[int], list[int], str, bool] | None:
    """Content hash, further hashes, paragraph hashes, content words as written and whether one of them may be misspelt; None for null and blank titles."""
    if title is None or not title.strip():
        return None
    text = _FIGURE.sub(lambda m: m.group().replace(m.group(1), ""), unicodedata.normalize("NFKC", title).lower().replace("&amp;", " "))
    names = {p for n in _NAME.findall(text) for p in n.split("-")}  # parts of a name are never misspelt words
    clauses = [c for c in (_words(c) for c in _CLAUSE.split(text)) if c]
    written_ = sorted(w for c in clauses for w in c) or sorted(_TOKEN.findall(text)) or [text.strip()]
    right: dict[str, str] = {}
    unsure: dict[str, tuple[str, ...]] = {}
    mark = []
    for w in written_:
        meant = speller.meant(w)
        if any(x.isdigit() for x in w) or (w not in speller.common and not meant):
            mark.append(w)
        elif len(meant) == 1 and len(w) >= SURE and w not in names:
            right[w] = meant[0]
        elif meant and w not in names:
            unsure[w] = meant
    fixed = [right.get(w, w) for w in written_]
    alts = set()
    if 0 < len(unsure) <= 3:  # further ones are left to the paragraphs
        for pick in product(*[(w, *m) for w, m in unsure.items()]):
            to = dict(zip(unsure, pick, strict=True))
            alts.add(_hash("f", *sorted(to.get(w, w) for w in fixed)))
    full = _hash("f", *sorted(fixed))
    key = mark or [f"#{len(fixed)}"]
    paragraphs = {_hash("p", *key, "|", *sorted(right.get(w, w) for w in c)) for c in clauses}
    bins: dict[int, list[str]] = {}
    for w in sorted(fixed):
        bins.setdefault(_hash("b", w) % 5, []).append(w)
    paragraphs |= {_hash("b", str(k), *key, "|", *b) for k, b in bins.items()}
    return full, sorted(alts - {full}), sorted(paragraphs), " ".join(sorted("~" + w if w in names else w for w in written_)), bool(unsure)


def same(a: str, b: str, common: frozenset[str]) -> bool:
    """Whether two lists of content words (``~`` before parts of a name) say the same: what differs is common words on one side, each near a word of the other that is no common one and no part of a name."""
    x, y = Counter(w.lstrip("~") for w in a.split(" ")), Counter(w.lstrip("~") for w in b.split(" "))
    left, right = sorted((x - y).elements()), sorted((y - x).elements())
    if len(left) != len(right):
        return False
    names = {w[1:] for t in (a, b) for w in t.split(" ") if w[:1] == "~"}
    plain = lambda w: len(w) >= SHORTEST and w.isalpha() and w not in names
    for w in left:
        hit = next((v for v in right if plain(w) and plain(v) and (w in common) != (v in common) and near(w, v)), None)
        if hit is None:
            return False
        right.remove(hit)
    return True


_PRINT = "b int, r long, pid string, full long, alts array<long>, paras array<long>, words string, open boolean"
_LONGS = pa.list_(pa.int64())


class Store:
    """The accepted history's hashes in a folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.n = spark, path, buckets
        part = lambda name, schema, key: Buckets(spark, f"history_{name}", schema, key, buckets, f"{path}/{name}")
        self.ids = part("ids", "pid string, b int", "pid")
        self.contents = part("contents", "full long, b int, r long, pid string, words string, open boolean", "full")
        self.alts = part("alts", "alt long, full long", "alt")
        self.paras = part("paras", "para long, full long, n int, open boolean", "para")
        self._common: frozenset[str] | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> Store:
        """The store at ``path``, begun there if there is none; without a path one in the shared folder."""
        path = path or new_path(spark, "history")
        if exists(spark, f"{path}/buckets/_SUCCESS"):
            buckets = spark.read.parquet(f"{path}/buckets").first()[0]
        else:
            buckets = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
            spark.range(1).selectExpr(f"{buckets} AS n").write.mode("overwrite").parquet(f"{path}/buckets")
        return cls(spark, path, buckets)

    def close(self) -> None:
        """Forget the tables; the folder stays."""
        for t in (self.ids, self.contents, self.alts, self.paras):
            t.close()

    def common(self, titles: DataFrame | None = None, title: str = "title") -> frozenset[str]:
        """The store's common words; counted over ``titles`` and kept where there are none yet."""
        if self._common is None:
            at = f"{self.path}/common"
            if not exists(self.spark, f"{at}/_SUCCESS"):
                if titles is None:
                    return frozenset()
                words = common_words(titles, title)
                if not words and titles.isEmpty():
                    return words
                self.spark.createDataFrame([(w,) for w in sorted(words)], "word string").coalesce(1).write.mode("overwrite").parquet(at)
            self._common = frozenset(r[0] for r in self.spark.read.parquet(at).collect())  # at most words of a title / COMMON
        return self._common

    def prints(self, df: DataFrame, batch: Column, row: Column, pid: Column, title: str) -> DataFrame:
        """b, r, pid, full, alts, paras, words, open of every row; the first rows that a store meets give its common words."""
        common = self.common(df, title)
        sent = self.spark.sparkContext.broadcast(common)
        made: dict[int, Speller] = {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            speller = made.get(0) or made.setdefault(0, Speller(sent.value))
            for x in batches:
                got = [fingerprint(t, speller) for t in x.column(3).to_pylist()]
                col = lambda k, t: pa.array([g and g[k] for g in got], t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*x.columns[:3], col(0, pa.int64()), col(1, _LONGS), col(2, _LONGS), col(3, pa.string()), pa.array([bool(g and g[4]) for g in got])], names=["b", "r", "pid", "full", "alts", "paras", "words", "open"])

        return df.select(batch.cast("int").alias("b"), row.cast("long").alias("r"), pid.alias("pid"), F.col(title).alias("title")).mapInArrow(run, _PRINT)

    def append(self, rows: DataFrame) -> None:
        """Hashes of accepted rows (a written table).  Copies of a content are kept once an append, with the first of them."""
        titled = rows.filter(F.col("full").isNotNull())
        self.ids.append(rows.filter(F.col("pid").isNotNull()).groupBy("pid").agg(F.min("b").alias("b")))
        self.contents.append(_firsts(titled))
        self.alts.append(titled.select(F.explode("alts").alias("alt"), "full").distinct())
        self.paras.append(_paragraphs(titled))

    def check(self, batch: DataFrame) -> DataFrame:
        """b, r, pid, full, alts, paras, words, open, repeats (true or false) and match (the accepted id) of every row of a batch (a written table), or of several in their order."""
        spark = self.spark
        titled = batch.filter(F.col("full").isNotNull())
        at: list[str] = []

        def kept(df: DataFrame, name: str) -> DataFrame:
            out, path = written_at(df, name)
            at.append(path)
            return out

        own = kept(_firsts(titled).select("full", "words", "open"), "own")
        since = batch.agg(F.min("b")).first()[0]
        since = since if since is not None else 0
        # What was accepted before the first batch of these: the same batch may be checked again.
        first = self.contents.read().filter(F.col("b") < since).groupBy("full").agg(F.min(F.struct("b", "r", "pid")).alias("first"))
        copies = kept(own.select(F.col("full").alias("x")).join(first, F.col("x") == F.col("full")).select("x", "first"), "copies")
        # Links between contents that are no full copies of the history: a further hash of one is the other's content.
        fresh = kept(own.join(copies.select(F.col("x").alias("full")), "full", "left_anti"), "fresh")
        own_alts = kept(titled.select(F.explode("alts").alias("alt"), "full").distinct().join(fresh.select("full"), "full", "left_semi"), "alts")
        pair = lambda df, x, y, old: df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(old).alias("old"))
        names = lambda df: df.select(F.col("full").alias("other"))
        links = [
            pair(own_alts.join(names(self.contents.read()), F.col("alt") == F.col("other")), "full", "other", True),
            pair(self.alts.read().join(names(fresh), F.col("alt") == F.col("other")), "other", "full", True),
            pair(own_alts.join(names(fresh), F.col("alt") == F.col("other")), "full", "other", False),
        ]
        paras = kept(_paragraphs(titled).join(fresh.select("full"), "full", "left_semi"), "paras")
        links += [self._covered(paras, self.paras.read(), fresh, self.contents.read().filter(F.col("b") < since), True), self._covered(paras, paras, fresh, fresh, False)]
        every = links[0]
        for one in links[1:]:
            every = every.unionByName(one)
        links = kept(every.distinct(), "links")
        by_copy = copies.select("x", F.lit(0).alias("k"), "first")
        by_link = links.filter("old").join(first, F.col("y") == F.col("full")).select("x", F.lit(1).alias("k"), "first")
        best = by_copy.unionByName(by_link).groupBy("x").agg(F.min(F.struct("k", "first")).alias("m"))
        history = kept(best.select("x", F.col("m.first.pid").alias("old_match"), F.lit(True).alias("old_title")), "met")
        known = self.ids.read().filter(F.col("b") < since).select(F.col("pid").alias("k_pid"), F.lit(True).alias("old_id")).join(batch.select(F.col("pid").alias("k_pid")).distinct(), "k_pid", "left_semi").distinct()
        # One id or one title may be that of a third of the batch.
        hot_ids, hot_titles = skew.hot_keys(batch, "pid"), skew.hot_keys(batch, "full")
        rows = skew.join(batch, known, "pid", "k_pid", hot_ids, how="left", nulls=True)
        rows = skew.join(rows, history, "full", "x", hot_titles, how="left", nulls=True)
        match = F.when(F.col("old_id"), F.col("pid")).when(F.col("old_title"), F.col("old_match"))
        state = F.when(F.col("old_id") | F.col("old_title"), F.lit(2))
        cols = ["b", "r", "pid", "full", "match", "state"]
        begun = kept(rows.select("b", "r", "pid", "full", match.alias("match"), state.cast("int").alias("state")), "begun")
        new_links = links.filter("NOT old")
        around = kept(new_links.select("x", "y").unionByName(new_links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "around")
        done = [begun.filter("state = 2")]
        live = kept(begun.filter("state IS NULL").select(*cols), "live")
        while True:
            settled = kept(self._settle(live, around, hot_ids, hot_titles).select(*cols), "settled")
            done.append(settled.filter("state = 2"))
            left = settled.filter("state IS NULL").isEmpty()
            live = settled.filter("state IS NULL OR state = 1")
            if left:
                break
        accepted = live
        out = accepted
        for d in done:
            out = out.unionByName(d)
        # An id accepted earlier in the batches decides, also where a title of the history was met first.
        taken = accepted.filter(F.col("pid").isNotNull()).groupBy("pid").agg(F.min(F.struct("b", "r")).alias("since")).select(F.col("pid").alias("k_pid"), "since")
        out = kept(out.select(*cols), "out")
        out = skew.join(out, taken, "pid", "k_pid", hot_ids, how="left", nulls=True)
        earlier = F.coalesce(F.col("since") < F.struct("b", "r"), F.lit(False))
        result = written(out.select("r", (F.col("state") == 2).alias("repeats"), F.when(F.col("state") == 2, F.when(earlier, F.col("pid")).otherwise(F.col("match"))).alias("match")), "checked")
        for path in at:
            drop_path(spark, path)
        return batch.join(result, "r")

    def _covered(self, mine: DataFrame, theirs: DataFrame, my_words: DataFrame, their_words: DataFrame, old: bool) -> DataFrame:
        """x, y, old: contents that share enough paragraphs and whose words say the same.  Only where one of the two has a word that may be misspelt."""
        a = mine.select("para", F.col("full").alias("x"), F.col("n").alias("xn"), F.col("open").alias("xo"))
        b = theirs.select("para", F.col("full").alias("y"), F.col("n").alias("yn"), F.col("open").alias("yo"))
        many = a.groupBy("para").agg(F.count("*").alias("k"), F.bool_or("xo").alias("o"))
        there = b.join(many.select("para"), "para", "left_semi").groupBy("para").agg(F.count("*").alias("k2"), F.bool_or("yo").alias("o2"))
        groups = written(many.join(there, "para").filter(F.col("o") | F.col("o2")).select("para", (F.greatest("k", "k2") > HOT).alias("hot")), "groups")
        cool, hot = groups.filter("NOT hot").select("para"), groups.filter("hot").select("para")
        order = F.lit(True) if old else F.col("x") < F.col("y")
        met = a.join(cool, "para").join(b, "para").filter((F.col("x") != F.col("y")) & order & (F.col("xo") | F.col("yo"))).select("para", "x", "y", "xn", "yn")
        if not hot.isEmpty():
            # Two contents that say the same have near words, one of them no common word; near words share a variant.
            left = self._refined(a.join(hot, "para"), "x", my_words)
            right = self._refined(b.join(hot, "para"), "y", their_words)
            fine = left.join(right, ["para", "variant"]).filter((F.col("x") != F.col("y")) & order & (F.col("x_rare") != F.col("y_rare")) & (F.col("x_word") != F.col("y_word")))
            met = met.unionByName(fine.select("para", "x", "y", "xn", "yn").distinct())
        shared = met.groupBy("x", "y").agg(F.count("*").alias("k"), F.first("xn").alias("xn"), F.first("yn").alias("yn")).filter(F.col("k") >= COVER * F.least("xn", "yn")).select("x", "y")
        words = lambda df, c: df.groupBy("full").agg(F.min("words").alias(f"{c}_words")).withColumnRenamed("full", c)
        pairs = shared.join(words(my_words, "x"), "x").join(words(their_words, "y"), "y").select("x", "y", "x_words", "y_words")
        sent = self.spark.sparkContext.broadcast(self.common())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                ok = pa.array([same(p, q, sent.value) for p, q in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["x", "y"]).filter(ok)

        return pairs.mapInArrow(run, "x long, y long").withColumn("old", F.lit(old))

    def _refined(self, rows: DataFrame, c: str, words: DataFrame) -> DataFrame:
        """The rows of hot paragraphs, one for each word and each of its variants."""
        sent = self.spark.sparkContext.broadcast(self.common())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                out: list[tuple] = []
                for full, text in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                    out += [(full, w, w not in sent.value, v) for w in dict.fromkeys(text.split(" ")) if len(w) >= SHORTEST and w.isalpha() for v in _variants(w)]
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.string())], names=["full", "word", "rare", "variant"])

        own = words.join(rows.select(F.col(c).alias("full")).distinct(), "full", "left_semi").groupBy("full").agg(F.min("words").alias("words"))
        each = own.mapInArrow(run, "full long, word string, rare boolean, variant string").select(F.col("full").alias(c), F.col("word").alias(f"{c}_word"), F.col("rare").alias(f"{c}_rare"), "variant")
        return rows.join(each, c)

    @staticmethod
    def _settle(live: DataFrame, around: DataFrame, hot_ids: list, hot_titles: list) -> DataFrame:
        """One pass over the unsettled rows: the first unsettled row of its id and of all contents around its own is settled, and so is each that an accepted row decides."""
        at, who = F.struct("b", "r"), F.struct("b", "r", "pid")
        sums = [F.min(F.when(F.col("state") == 1, who)).alias("acc"), F.min(F.when(F.col("state").isNull(), at)).alias("und")]
        by_id = live.filter(F.col("pid").isNotNull()).groupBy("pid").agg(*sums).select(F.col("pid").alias("k_pid"), F.col("acc").alias("id_acc"), F.col("und").alias("id_und"))
        by_content = live.filter(F.col("full").isNotNull()).groupBy("full").agg(*sums)
        beside = around.join(by_content, F.col("y") == F.col("full")).select(F.col("x").alias("full"), "acc", "und")
        by_title = by_content.unionByName(beside).groupBy("full").agg(F.min("acc").alias("t_acc"), F.min("und").alias("t_und")).withColumnRenamed("full", "k_full")
        open_ = skew.join(live.filter(F.col("state").isNull()), by_id, "pid", "k_pid", hot_ids, how="left", nulls=True)
        open_ = skew.join(open_, by_title, "full", "k_full", hot_titles, how="left", nulls=True)
        earlier = lambda c: F.coalesce(F.struct(F.col(f"{c}.b"), F.col(f"{c}.r")) < at, F.lit(False)) & F.col(c).isNotNull()
        by = earlier("id_acc") | earlier("t_acc")
        waits = earlier("id_und") | earlier("t_und")
        state = F.when(by & (earlier("id_acc") | ~waits), 2).when(~by & ~waits, 1)
        match = F.when(F.col("state") == 2, F.when(F.col("by_id"), F.col("pid")).otherwise(F.col("t_acc.pid")))
        now = open_.withColumn("by_id", earlier("id_acc")).withColumn("state", state.cast("int")).withColumn("match", match)
        return live.filter("state = 1").unionByName(now.select(*live.columns))


def _firsts(titled: DataFrame) -> DataFrame:
    """Each content with the first row that has it."""
    g = titled.groupBy("full").agg(F.min(F.struct("b", "r", "pid", "words")).alias("f"), F.bool_or("open").alias("open"))
    return g.select("full", "f.b", "f.r", "f.pid", "f.words", "open")


def _paragraphs(titled: DataFrame) -> DataFrame:
    """para, full, n, open: the paragraphs of each content, of all its spellings."""
    return titled.select(F.explode("paras").alias("para"), "full", F.size("paras").alias("n"), "open").groupBy("para", "full").agg(F.min("n").alias("n"), F.bool_or("open").alias("open"))
