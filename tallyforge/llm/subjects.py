"""Subject areas of documents by class-association rules.

A sentence is a transaction of its informative items (words and runs of two or three words), a rule says that an item
set goes with a subject.

1. Seeds: items of the labelled texts (and of labelled term lists) that keep to one subject.
2. Documents whose sentences the seeds give to one subject become labelled transactions; the items of all of them are
   counted by subject, partly summed where they are read.
3. Items whose share within one subject stands out are informative; a run of words is one only if it tells more than
   its parts.
4. Item sets of any length are counted by subject over the whole labelled transactions, one length after the other;
   those with enough confidence are rules, and a rule is redundant if a part of its item set has no less.  A set is
   made longer only while that may still give a rule (see ``_Sets``), which loses none.
5. A sentence's evidence for a subject is the sum of the log odds of its matching rules, with confidences smoothed and
   set against the subject's share of the transactions; the least evidence is calibrated on the labelled texts.
   A document has a subject if two or more of its sentences are about it, and keeps at most three.

Item sets occur in at least ``SUPPORT`` of the labelled sentences with a subject, so the rules that are sent to the
executors are bounded whatever the number of documents.

Defined cases: null, blank and empty texts have no subject; repeated documents are treated alike; extra columns are
ignored; without labelled texts there are no rules and no subjects.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import written

SUPPORT, LEAST_COUNT, CONFIDENCE, SIGMAS = 2e-5, 4, 0.6, 3.5
MOST_SUBJECTS, LEAST_SENTENCES = 3, 2
#: How much stronger than each of its parts a rule has to be.
BETTER = 1e-3
#: A document labels its sentences if so many of them are given to a subject, with this share to the first one.
SEED_SENTENCES, SEED_SHARE = 2, 0.75
FLUSH = 300_000
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\s*\n+\s*")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def items(sentence: str) -> list[str]:
    """Distinct words and runs of two and three words, in order."""
    w = _WORD.findall(sentence.lower())
    return list(dict.fromkeys([*w, *[" ".join(x) for x in zip(w, w[1:])], *[" ".join(x) for x in zip(w, w[1:], w[2:])]]))


def split(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()] if text else []


def seeds(texts: list[tuple[str, str]], terms: list[tuple[str, str]]) -> dict[str, tuple[str, float]]:
    """item: (subject, weight) of items of the labelled texts that keep to one subject."""
    count: dict[str, Counter] = defaultdict(Counter)
    for subject, text in texts:
        for s in split(text):
            for i in items(s):
                count[i][subject] += 1
    out = {}
    for i, c in count.items():
        (subject, n), total = c.most_common(1)[0], sum(c.values())
        if n / total >= 0.85 and (n >= 3 or (" " in i and n >= 2)):
            out[i] = (subject, math.log((n + 0.5) / (total - n + 0.5)))
    for subject, term in terms:
        t = " ".join(_WORD.findall(term.lower()))
        if t and (t not in out or out[t][0] == subject):
            out[t] = (subject, 2.0)
    return out


def _seed_subject(sentence_items: list[str], rules: dict[str, tuple[str, float]]) -> str | None:
    score: Counter = Counter()
    for i in sentence_items:
        r = rules.get(i)
        if r:
            score[r[0]] += r[1]
    top = score.most_common(2)
    if not top or top[0][1] < 1.0 or (len(top) > 1 and top[1][1] > 0.5 * top[0][1]):
        return None
    return top[0][0]


def _labelled(text: str, rules: dict) -> tuple[str, list[list[str]]] | None:
    """The subject that the seeds give a document, and its sentences' items."""
    all_items = [items(s) for s in split(text)]
    got = Counter(x for x in (_seed_subject(i, rules) for i in all_items) if x)
    if not got:
        return None
    subject, n = got.most_common(1)[0]
    if n < SEED_SENTENCES or n < SEED_SHARE * sum(got.values()):
        return None
    return subject, all_items


def _item_counts(df: DataFrame, text: str, rules: dict) -> DataFrame:
    """item, subject, n over the sentences of the documents that the seeds label; item '' counts sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_pydict({"item": pa.array([k[0] for k in count], pa.string()), "subject": pa.array([k[1] for k in count], pa.string()), "n": pa.array(list(count.values()), pa.int64())})
            count.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                got = _labelled(t, rules) if t else None
                if got:
                    for i in got[1]:
                        count.update((x, got[0]) for x in i)
                        count["", got[0]] += 1
                if len(count) > FLUSH:
                    yield out()
        yield out()

    return df.select(text).mapInArrow(run, "item string, subject string, n long").groupBy("item", "subject").agg(F.sum("n").alias("n"))


def _informative(counts: DataFrame, least: float) -> dict[str, tuple[str, float]]:
    """item: (subject, relative confidence) of items that stand out in one subject; runs no better than a part are left out."""
    total = {r.subject: r.n for r in counts.filter(F.col("item") == "").collect()}
    classes = sorted(total)
    if len(classes) < 2:
        return {}
    share = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(1.0 / total[c]))])
    rel = counts.filter(F.col("item") != "").withColumn("rel", F.col("n") * share[F.col("subject")])
    per = rel.groupBy("item").agg(F.sum("n").alias("n"), F.sum("rel").alias("all"), F.max_by("subject", "rel").alias("subject"), F.max("rel").alias("top"))
    # How many standard deviations the subject's count lies above what its share of all sentences would give.
    part = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(total[c] / sum(total.values())))])[F.col("subject")]
    own = F.col("top") * F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(float(total[c])))])[F.col("subject")]
    clear = own - F.col("n") * part >= SIGMAS * F.sqrt(F.col("n") * part * (1 - part))
    kept = per.filter((F.col("n") >= least) & (F.col("top") >= CONFIDENCE * F.col("all")) & clear)
    conf = {r.item: (r.subject, r.top / r.all) for r in kept.select("item", "subject", "top", "all").collect()}  # at most items of a sentence / SUPPORT
    out = {}
    for i, (s, c) in conf.items():
        w = i.split(" ")
        inside = [" ".join(w[a:b]) for a in range(len(w)) for b in range(a + 1, len(w) + 1) if b - a < len(w)]
        if all(conf[p][0] != s or conf[p][1] < c - 0.02 for p in inside if p in conf):
            out[i] = (s, c)
    return out


def _transactions(df: DataFrame, text: str, rules: dict, kept: dict[str, tuple[str, float]]) -> DataFrame:
    """subject, items, n: how many sentences of the documents that the seeds label have these informative items."""

    sent = df.sparkSession.sparkContext.broadcast((rules, kept))  # both bounded, see _informative and seeds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, kept = sent.value
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                got = _labelled(t, rules) if t else None
                if got:
                    for i in got[1]:
                        own = sorted(x for x in i if x in kept)
                        if own:
                            rows.append((got[0], own))
            yield pa.RecordBatch.from_pydict({"subject": pa.array([r[0] for r in rows], pa.string()), "items": pa.array([r[1] for r in rows], pa.list_(pa.string()))})

    return df.select(text).mapInArrow(run, "subject string, items array<string>").groupBy("subject", "items").agg(F.count("*").alias("n"))


ItemSet = tuple[str, ...]


def _longer(own: list[str], size: int, by_first: dict[str, list[ItemSet]]) -> Iterable[ItemSet]:
    """The sets of ``size`` sorted items of a transaction of which all parts one item shorter are open."""
    if size == 1:
        return [(x,) for x in own]
    if size == 2:
        return combinations([x for x in own if x in by_first], 2)
    have = frozenset(own)
    there = {k for x in own for k in by_first.get(x, ()) if have.issuperset(k)}
    by_prefix: dict[ItemSet, list[str]] = defaultdict(list)
    for k in sorted(there):
        by_prefix[k[:-1]].append(k[-1])
    joined = ((*prefix, *two) for prefix, last in by_prefix.items() for two in combinations(last, 2))
    return [k for k in joined if all(k[:j] + k[j + 1 :] in there for j in range(size - 2))]


def _set_counts(rows: DataFrame, size: int, open_sets: Iterable[ItemSet], least: float) -> Iterator[tuple[ItemSet, dict[str, int]]]:
    """Item sets of ``size`` with their transactions by subject, of those that occur ``least`` times with one."""
    by_first: dict[str, list[ItemSet]] = defaultdict(list)
    for k in open_sets:
        by_first[k[0]].append(k)
    sent = rows.sparkSession.sparkContext.broadcast(dict(by_first))  # at most items of a transaction / SUPPORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_first = sent.value
        count: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_pydict({"items": pa.array(["\t".join(k[0]) for k in count], pa.string()), "subject": pa.array([k[1] for k in count], pa.string()), "n": pa.array(list(count.values()), pa.int64())})
            count.clear()
            return b

        for b in batches:
            for subject, own, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for k in _longer(own, size, by_first):
                    count[k, subject] += n
                if len(count) > FLUSH:
                    yield out()
        yield out()

    by_subject = rows.select("subject", "items", "n").mapInArrow(run, "items string, subject string, n long").groupBy("items", "subject").agg(F.sum("n").alias("n"))
    sets = by_subject.groupBy("items").agg(F.max("n").alias("most"), F.collect_list(F.struct("subject", "n")).alias("by"))
    for r in sets.filter(F.col("most") >= least).select("items", "by").toLocalIterator():
        yield tuple(r["items"].split("\t")), {x["subject"]: x["n"] for x in r["by"]}


class _Sets:
    """Takes item sets, the shorter ones first; keeps the rules and says which sets may still give longer rules.

    Two kinds of sets are closed, with all that contain them.  One occurs in the same transactions as a part of it: it
    has that part's strength, and each set around it that of the same set around the part.  In the other, for each
    subject, a part is already as strong as a set would be all of whose transactions have the subject.
    """

    def __init__(self, prior: dict[str, int], least: float):
        self.prior, self.least = prior, least
        self.rules: list[tuple[ItemSet, str, float]] = []
        self.last: dict[ItemSet, tuple[dict[str, int], dict[str, float]]] = {}  # of the open sets: counts, most strength of any part by subject

    def take(self, sets: Iterable[tuple[ItemSet, dict[str, int]]]) -> list[ItemSet]:
        """The sets that are open, of some that are all one item longer than those before."""
        now = {}
        for k, by in sets:
            parts = [self.last[k[:j] + k[j + 1 :]] for j in range(len(k))] if len(k) > 1 else []
            if any(p[0] == by for p in parts):
                continue
            best: dict[str, float] = {}
            for _, strength in parts:
                for s, c in strength.items():
                    best[s] = max(c, best.get(s, 0.0))
            share = {s: by[s] / self.prior[s] for s in sorted(by)}
            subject = max(share, key=share.get)
            if by[subject] >= self.least:
                c = (share[subject] / sum(share.values()) * by[subject] + 0.5) / (by[subject] + 1.5)
                if c >= CONFIDENCE and best.get(subject, 0.0) < c - BETTER:
                    self.rules.append((k, subject, math.log(c / (1 - c))))
                best[subject] = max(c, best.get(subject, 0.0))
            if any(n >= self.least and best.get(s, 0.0) < (n + 0.5) / (n + 1.5) - BETTER for s, n in by.items()):
                now[k] = (by, best)
        self.last = now
        return list(now)


def mine(df: DataFrame, text: str, labelled: list[tuple[str, str]], terms: list[tuple[str, str]]) -> list[tuple[tuple[str, ...], str, float]]:
    """(item set, subject, weight) of the rules."""
    seed = seeds(labelled, terms)
    if not seed:
        return []
    counts = written(_item_counts(df, text, seed), "items")
    n = counts.filter(F.col("item") == "").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, SUPPORT * n)
    kept = _informative(counts, least)
    if not kept:
        return []
    rows = written(_transactions(df, text, seed, kept), "transactions")
    return rules_of(rows, least)


def rules_of(rows: DataFrame, least: float) -> list[tuple[ItemSet, str, float]]:
    """(item set, subject, weight) of the rules of transactions (subject, items in order, n)."""
    prior = {r["subject"]: r["n"] for r in rows.groupBy("subject").agg(F.sum("n").alias("n")).collect()}
    sets = _Sets(prior, least)
    size, left = 1, sets.take(_set_counts(rows, 1, [], least))
    while left:
        size += 1
        left = sets.take(_set_counts(rows, size, left, least))
    return sorted(sets.rules)


class Judge:
    """Evidence of the matching rules for the subjects of a sentence."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float]]):
        self.by: dict[str, list[tuple[frozenset[str], str, float]]] = defaultdict(list)
        for k, s, w in rules:
            self.by[k[0]].append((frozenset(k), s, w))
        self.seen: dict[str, tuple[str, float] | None] = {}

    def sentence(self, s: str) -> tuple[str, float] | None:
        """The subject with the most evidence, and how much more that is than the next one's."""
        if s in self.seen:
            return self.seen[s]
        own = items(s)
        have = frozenset(own)
        score: Counter = Counter()
        for i in own:
            for k, subject, w in self.by.get(i, ()):
                if len(k) == 1 or k <= have:
                    score[subject] += w
        top = score.most_common(2)
        got = (top[0][0], top[0][1] - (top[1][1] if len(top) > 1 else 0.0)) if top else None
        if len(self.seen) > FLUSH:
            self.seen.clear()
        self.seen[s] = got
        return got

    def document(self, text: str | None, least: float) -> list[tuple[str, int]]:
        """(subject, sentences) of a text, the most sentences first."""
        got = Counter()
        for s in split(text):
            x = self.sentence(s)
            if x and x[1] >= least:
                got[x[0]] += 1
        return sorted(((s, n) for s, n in got.items() if n >= LEAST_SENTENCES), key=lambda x: (-x[1], x[0]))[:MOST_SUBJECTS]


def calibrated(judge: Judge, labelled: list[tuple[str, str]]) -> float:
    """The least evidence with the best F1 on the sentences of the labelled texts."""
    marks = []
    for subject, text in labelled:
        for s in split(text):
            x = judge.sentence(s)
            marks.append((x[1] if x else -1.0, bool(x) and x[0] == subject))
    best, at = -1.0, 1.0
    for t in [1.0 + 0.1 * k for k in range(21)]:
        right = sum(ok for v, ok in marks if v >= t)
        given = sum(v >= t for v, _ in marks)
        f1 = 2 * right / (given + len(marks) + 1e-9)
        if f1 > best + 1e-9:
            best, at = f1, t
    return at


def assigned(df: DataFrame, key: str, text: str, labelled: list[tuple[str, str]], terms: list[tuple[str, str]]) -> DataFrame:
    """key, subject, sentences of every subject of every document."""
    spark = df.sparkSession
    rows = df.select(text, key)
    rules = mine(rows, text, labelled, terms)
    judge = Judge(rules)
    least = calibrated(judge, labelled)
    model = spark.sparkContext.broadcast((rules, least))
    made: dict[int, Judge] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, least = model.value
        j = made.get(0) or made.setdefault(0, Judge(rules))
        for b in batches:
            got = [(i, s, n) for i, t in enumerate(b.column(0).to_pylist()) for s, n in j.document(t, least)]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array([x[0] for x in got], pa.int64())), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.int32())], names=[key, "subject", "sentences"])

    return rows.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, subject string, sentences int")
