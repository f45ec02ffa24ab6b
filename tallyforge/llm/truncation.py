"""Texts cut off by a field limit or a broken transfer.

Positives are made by cutting intact texts (those that end with a full stop, a question or an exclamation mark) at
random places and at the limits of their own source; negatives are the same texts as they are and with casual endings.
A logistic regression on hashed closing characters and words, punctuation, open brackets and links, the length's place
among the source's lengths, and how often the closing words end a sentence elsewhere, scores every record.

The limits of a source are the lengths that far more of its records have than have the lengths around; they are found
over all records.  How often words end a sentence is counted over all intact texts, in a table of ``TABLE`` places by hash
(words that share a place share their counts), in two halves of the texts so that none is trained with its own counts.
All intact texts are trained on: groups of about ``GROUP``, by a hash of id and text, each learn weights, and a feature's
weight is the mean over the groups, by how often the feature occurs there.

Defined cases: null, blank, deleted and removed texts are complete (score 0); a repeated id is scored by its highest
score; a null source is a source of its own; without intact texts nothing can be learned and every score is 0.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.logistic import Block, Rows, bucket, fit

GROUP = 10_000
WIDTH, TABLE = 1 << 18, 1 << 21
#: A limit: a length that at least this share of a source's records have, and so many times those around it.
SPIKE_SHARE, SPIKE_TIMES, AROUND = 0.004, 4.0, 15
#: Endings people write that are no cut, and marks that readers put after a cut.
CASUAL = ["", "", "", "", "..", "...", "…", " ...", " :)", " :-)", " ;)", " :(", " :D", " lol", " thx", " ymmv", " /s", " 👍", " 🙂", " EDIT: typo", " cheers", " imo", " haha", "!!", " xD", " ^^", " <3", " tldr", " fwiw", " 🔧"]
MARKS = ["", "", "", "", "", "…", "...", " [...]", "�"]
BREAKS = ["&am", "&quo", "&#82", "&l", "&nbs", " https://forum.exa", " (https://wiki.", " [link](https://host.exam", " http", " www.forum", "%C3%", "\\u00e", " (see the", " [the"]
GONE = ("[deleted]", "[removed]")

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
# Possessive throughout: a run of marks is taken once, so long runs cost no more than their length.
_CLOSER = re.compile(r"(?:\s*+(?:\.\.++|…++|\[\.\.\.\]|\[…\]|[!?.]++|[:;][-']?[)(DPp/|]|<3|\^\^|xD|(?<!\S)(?:/s|/j|lol|haha|ymmv|imo|fwiw|thx|cheers|tldr|edit: ?\w++)|[\U0001F300-\U0001FAFF☀-➿️]++))++\s*$", re.I)
#: What a run without blanks within closing marks may be made of (at least); ``edit: word`` has a blank.
_LIKE = re.compile(r"(?:[.…!?\[\]:;'\-)(DPp|<3^x\U0001F300-\U0001FAFF☀-➿️]|/[sj]?+|lol|haha|ymmv|imo|fwiw|thx|cheers|tldr|edit:\w*+)++", re.I)
_LINK, _SCHEME, _CODE = re.compile(r"(?:https?:|www\.)[^\s)]*$"), re.compile(r"\bhttps?$|\bwww$"), re.compile(r"&#?\w{0,7}$|%[0-9A-Fa-f]?$|\\u?[0-9a-fA-F]{0,3}$")
_JOINT = frozenset([",", ";", ":", "-", "–", "—", "/", "&", "'", "’"])
KINDS, LIMITS = ("none", "dots", "bracket", "stop", "other"), ("off", "at", "before", "beyond")
FLAGS = ("open(", "open[", "open“", "open«", "openquote", "link", "link", "code", "broken", "joint")
_INTACT = r"[\p{L}\p{N})][.!?]$"


def limits(df: DataFrame, text: str, source: str) -> dict[str | None, list[int]]:
    """The lengths at which each source cuts, from the lengths of all its records."""
    counts = df.filter(F.col(text).isNotNull()).groupBy(F.col(source).alias("s"), F.length(text).alias("n")).count()
    around = Window.partitionBy("s").orderBy("n").rangeBetween(-AROUND, AROUND)
    whole = Window.partitionBy("s")
    spread = counts.withColumn("near", (F.sum("count").over(around) - F.col("count")) / (2.0 * AROUND)).withColumn("all", F.sum("count").over(whole))
    spikes = spread.filter((F.col("n") > 40) & (F.col("count") >= SPIKE_SHARE * F.col("all")) & (F.col("count") >= 8) & (F.col("count") > SPIKE_TIMES * F.greatest(F.col("near"), F.lit(0.5))))
    out: dict[str | None, list[int]] = {}
    for r in spikes.select("s", "n").collect():  # at most 1 / SPIKE_SHARE a source
        out.setdefault(r.s, []).append(r.n)
    return out


class Endings:
    """How often the last one to four words of sentences end one, and whether they are known at all."""

    def __init__(self, texts: Iterable[str] = (), counts: np.ndarray | None = None):
        """``counts``: occurrences and endings at each place of the table; else those of ``texts``."""
        self.total, self.final = counts if counts is not None else _Counter().add(texts).counts().sum(axis=0)

    def found(self, codes: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences and endings of the last one to four words of rows with ``m`` of them (``codes``, the last word last)."""
        total, final = np.zeros((4, len(m)), np.int64), np.zeros((4, len(m)), np.int64)
        for n in range(1, 5):
            h = np.full(len(m), n, np.uint64)
            for j in range(4 - n, 4):
                h = h * np.uint64(_TIMES) + codes[:, j]
            at = (h * np.uint64(_SPREAD) >> np.uint64(_SHIFT)).astype(np.int64)
            total[n - 1] = np.where(m >= n, self.total[at], 0)
            final[n - 1] = np.where(total[n - 1] > 0, self.final[at], 0)
        return total, final

    def features(self, w: list[str]) -> list[tuple[str, float]]:
        """Names and values for closing words."""
        codes, m = _codes([w])
        states, values = _states(*self.found(codes, m))
        known = _known(int(states[0]))
        named = [x for n in range(1, 5) if int(states[0]) // 3 ** (n - 1) % 3 for x in ((f"ends{n}", float(values[n - 1, 0])), (_state(int(states[0]), n), 1.0))]
        return named + [(f"known{known}/{m[0]}", 1.0)] + ([("longest", float(values[4, 0])), (_longest(int(states[0])), 1.0)] if known else [])


def _codes(last: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of rows' last words, at most four, and how many they are."""
    flat = array("Q")
    for w in last:
        flat.extend([0] * (4 - len(w)) + [_code(x) for x in w[-4:]])
    return np.array(flat, np.uint64).reshape(-1, 4), np.minimum([len(w) for w in last], 4)


def _states(total: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the last one to four words are not known, never end or can end a sentence (0, 1, 2 as digits of base 3), and their log odds, those of the longest that are known last."""
    rate = (final + 0.2) / (total + 0.4)
    values = np.where(total > 0, np.log(rate / (1 - rate)), 0.0)
    longest = np.zeros(total.shape[1])
    for t, v in zip(total, values, strict=True):
        longest = np.where(t > 0, v, longest)
    states = (np.where(total > 0, 1 + (final > 0), 0) * np.array([[1], [3], [9], [27]])).sum(axis=0)
    return states, np.vstack([values, longest])


def _known(states: int) -> int:
    return max((n for n in range(1, 5) if states // 3 ** (n - 1) % 3), default=0)


def _state(states: int, n: int) -> str:
    return f"{('', 'never', 'can')[states // 3 ** (n - 1) % 3]}{n}"


def _longest(states: int) -> str:
    known = _known(states)
    return f"longest{known}{'never' if states // 3 ** (known - 1) % 3 == 1 else ''}"


_ALL, _TIMES, _SPREAD, _SHIFT = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 65 - TABLE.bit_length()


@lru_cache(1 << 16)
def _code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


@lru_cache(1 << 16)
def _found_code(x: str) -> int:
    """The code of a word as it is found in a text."""
    return _code(_word(x))


def half(text: str) -> int:
    """The half of the texts that a text is counted in; like texts in the same."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) >> 7 & 1


class _Counter:
    """Occurrences and endings of one to four words in each half of the texts, at the places of a table of fixed size."""

    def __init__(self):
        self.all, self.codes, self.sizes, self.halves = np.zeros(4 * TABLE, np.int64), array("Q"), array("q"), array("b")

    def add(self, texts: Iterable[str]) -> _Counter:
        for t in texts:
            where = half(t)
            for s in _SENTENCE.split(t):
                if not s or s[-1] not in ".!?":
                    continue
                w = _WORD.findall(s)
                while w and (w[-1].isdigit() or not w[-1][0].isalnum()):
                    w.pop()
                if w:
                    self.codes.extend(map(_found_code, w))
                    self.sizes.append(len(w))
                    self.halves.append(where)
            if len(self.codes) > 1_000_000:
                self._sum()
        return self

    def _sum(self) -> None:
        codes, sizes = np.array(self.codes, np.uint64), np.array(self.sizes, np.int64)
        ends = np.cumsum(sizes)
        at = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
        halves, last = np.repeat(np.array(self.halves, np.int64), sizes), np.zeros(len(codes), bool)
        last[ends - 1] = True
        for n in range(1, 5):
            i = np.flatnonzero(at >= n - 1)
            h = np.full(len(i), n, np.uint64)
            for j in range(n - 1, -1, -1):
                h = h * np.uint64(_TIMES) + codes[i - j]
            place = (h * np.uint64(_SPREAD) >> np.uint64(_SHIFT)).astype(np.int64) + 2 * TABLE * halves[i]
            np.add.at(self.all, place, 1)
            np.add.at(self.all, place[last[i]] + TABLE, 1)
        self.codes, self.sizes, self.halves = array("Q"), array("q"), array("b")

    def counts(self) -> np.ndarray:
        """By half, then occurrences and endings."""
        self._sum()
        return self.all.reshape(2, 2, TABLE)


def packed(counts: np.ndarray) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """Counts without the empty places, for sending."""
    at = np.flatnonzero(counts)
    return counts.shape, at.astype(np.int32), counts.reshape(-1)[at]


def unpacked(shape: tuple[int, ...], at: np.ndarray, n: np.ndarray) -> np.ndarray:
    flat = np.zeros(math.prod(shape), np.int64)
    flat[at] = n
    return flat.reshape(shape)


def counted(intact: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """The number of texts, and the counts of all of them: what reaches the driver is a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n = _Counter(), 0
        for b in batches:
            c.add(b.column(0).to_pylist())
            n += b.num_rows
        if n:
            flat = c.counts().reshape(-1)
            at = np.flatnonzero(flat)
            for k in range(0, len(at), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 200_000]), pa.array(flat[at[k : k + 200_000]])], names=["place", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([n], pa.int64())], names=["place", "n"])

    found = intact.select(text).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column("place").to_numpy(), found.column("n").to_numpy()
    return int(n[at < 0].sum()), unpacked((2, 2, TABLE), at[at >= 0], n[at >= 0])


def _word(x: str) -> str:
    return "#" if x.isdigit() else x.lower()


def _start(tail: str) -> int:
    """A place at or before the closing marks of a line, mostly shortly before: a run without blanks that can't be among them, or within an ``edit: word``."""
    end = len(tail)
    for _ in range(8):
        run = tail[:end].rsplit(None, 1)
        if not run:
            return 0
        start = end - len(run[-1])
        if not _LIKE.fullmatch(run[-1]) and tail[max(start - 2, 0) : start] != ": ":
            return start
        end = len(tail[:start].rstrip())
    return 0


def _last_sentence(body: str) -> str:
    """What is after the last sentence's end that has a blank after it; ``body`` is one line."""
    k = max(body.rfind(". "), body.rfind("! "), body.rfind("? "), body.rfind("… "))
    rest = body[k + 1 :].lstrip() if k >= 0 else body
    return _SENTENCE.split(rest)[-1] if "." in rest or "!" in rest or "?" in rest or "…" in rest else rest


def _last_words(sentence: str) -> list[str]:
    """The last words, from a word or number on back: four, or all that there are."""
    first = sentence.rsplit(None, 6)
    for part in (sentence[len(first[0]) :], sentence) if len(first) == 7 else (sentence,):  # no word has a blank in it
        w = _WORD.findall(part)
        while w and not w[-1][0].isalnum() and w[-1] != "#":
            w.pop()
        if len(w) >= 4:
            break
    return [_word(x) for x in w[-4:]]


def closing(text: str) -> tuple[int, str, list[str], int]:
    """The kind of a text's closing marks; the last three characters, the last four words and the flags (bits) of the sentence before them."""
    tail = text.rstrip().rsplit("\n", 1)[-1]
    closer = _CLOSER.search(tail, _start(tail))
    mark = closer.group().strip() if closer else ""
    flat = _last_sentence(tail[: closer.start()] if closer else tail)
    kind = 0 if not mark else 1 if mark == "…" or (len(mark) > 1 and not mark.strip(".")) else 2 if "[" in mark else 3 if not mark.strip(".!?") else 4
    flags = 0
    for k, (a, b) in enumerate(("()", "[]", "“”", "«»")):
        if a in flat and flat.count(a) > flat.count(b):
            flags |= 1 << k
    if ("`" in flat and flat.count("`") % 2) or ('"' in flat and flat.count('"') % 2):
        flags |= 16
    if "http" in flat or "www" in flat:
        flags |= bool(_LINK.search(flat)) << 5 | bool(_SCHEME.search(flat)) << 6
    if ("&" in flat or "%" in flat or "\\" in flat) and _CODE.search(flat, max(len(flat) - 9, 0)):
        flags |= 128
    if "�" in tail[-3:]:
        flags |= 256
    if flat[-1:] in _JOINT:
        flags |= 512
    return kind, flat.rstrip()[-3:], _last_words(flat), flags


def _placed(*named: tuple[str, float]) -> list[tuple[int, float]]:
    return [(bucket(n, WIDTH), v) for n, v in named]


@lru_cache(1 << 14)
def _common(code: int) -> list[tuple[int, float]]:
    """Features of kind, limit, number of words, what is known of them, and flags; these as one number."""
    code, flags = divmod(code, 1 << len(FLAGS))
    code, states = divmod(code, 81)
    code, m = divmod(code, 5)
    kind, limit = KINDS[code // len(LIMITS)], LIMITS[code % len(LIMITS)]
    named = [f"kind={kind}", f"limit={limit}", f"kind={kind},limit={limit}", "one", f"short={min(m, 3)}", f"{kind}:known{_known(states)}/{m}"]
    named += [f"{kind}:{_state(states, n)}" for n in range(1, 5) if states // 3 ** (n - 1) % 3]
    named += [f"{kind}:{_longest(states)}"] if states else []
    return _placed(*((x, 1.0) for x in [*named, *(x for k, x in enumerate(FLAGS) if flags >> k & 1)]))


@lru_cache(1 << 16)
def _lettered(kind: int, last: str) -> list[tuple[int, float]]:
    return _placed(*((f"c{n}={KINDS[kind]}{last[-n:].lower()}", 0.5) for n in (1, 2, 3)))


@lru_cache(1 << 16)
def _worded(kind: int, word: str | None) -> list[tuple[int, float]]:
    return [] if word is None else _placed((f"w={KINDS[kind]}{word}", 0.5), (f"w={word}", 0.5))


_VALUED = [[[(bucket(f"{k}:{n}", WIDTH), 1.0)] for k in KINDS] for n in ("ends1", "ends2", "ends3", "ends4", "longest")]


def encoded(texts: list[str], at_limit: list[str], endings: list[Endings], halves: list[int] | None = None) -> Rows:
    """Features of texts; ``at_limit`` is how their lengths lie to their sources' limits, ``halves`` which of the endings each is seen with."""
    kinds, letters, last, flags = zip(*map(closing, texts), strict=True)
    codes, m = _codes(last)
    kind = np.array(kinds, np.int64)
    total, final = endings[0].found(codes, m)
    if halves is not None:
        other, in_other = endings[1].found(codes, m), np.array(halves) == 1
        total, final = np.where(in_other, other[0], total), np.where(in_other, other[1], final)
    states, values = _states(total, final)
    limit = np.array([LIMITS.index(x) for x in at_limit], np.int64)
    common, which = np.unique((((kind * len(LIMITS) + limit) * 5 + m) * 81 + states) * (1 << len(FLAGS)) + np.array(flags, np.int64), return_inverse=True)
    blocks = [Block(which, [_common(int(c)) for c in common])]
    for keys, of in ((zip(kinds, letters, strict=True), _lettered), (((k, w[-1] if w else None) for k, w in zip(kinds, last, strict=True)), _worded)):
        known: dict = {}
        which = np.array([known.setdefault(x, len(known)) for x in keys], np.int64)
        blocks.append(Block(which, [of(*x) for x in known]))
    there = [*(total > 0), states > 0]
    return Rows(len(texts), [*blocks, *(Block(kind, p, v, t) for p, v, t in zip(_VALUED, values, there, strict=True))])


def features(text: str, at_limit: str, endings: Endings) -> list[tuple[int, float]]:
    """Places and values of a text's features; ``at_limit`` is how its length lies to the source's limits."""
    return encoded([text], [at_limit], [endings]).row(0)


def place(n: int, source: str | None, spikes: dict[str | None, list[int]]) -> str:
    own = spikes.get(source, [])
    return "at" if n in own else "before" if any(0 < x - n <= 2 for x in own) else "beyond" if own and n > max(own) else "off"


def _cut(t: str, rng: random.Random, spikes: list[int]) -> str | None:
    fit_ = [x for x in spikes if x < len(t) - 1]
    n = rng.choice(fit_) if fit_ and rng.random() < 0.5 else rng.randint(1, len(t) - 2)
    c = t[:n].rstrip()
    if rng.random() < 0.12:
        return c + rng.choice(BREAKS)
    if not c or re.search(r"[.!?…]$", c) or (t[n : n + 1] in ".!?\n" and c[-1].isalnum()):
        return None
    return c


def examples(t: str, source: str | None, spikes: dict[str | None, list[int]], rng: random.Random, every: bool) -> list[tuple[str, int]]:
    """Whole and cut texts made of an intact one: ``every`` kind, else one whole text of any kind and in three of four cases a cut one."""
    last = re.sub(r"[.!?]+$", "", t)
    whole = [0, 1, 2, 3] if every else [rng.randrange(4)]
    texts = [(t, 0) for k in whole if k == 0] + [(last + rng.choice(CASUAL), 0) for k in whole if k in (1, 2)]
    if 3 in whole:  # an intact text that ends earlier
        sentences = _SENTENCE.split(t)
        if len(sentences) > 1:
            k = rng.randint(1, len(sentences) - 1)
            part = t[: t.find(sentences[k], sum(map(len, sentences[:k])))].rstrip()
            if re.search(r"[.!?]$", part):
                texts.append((re.sub(r"[.!?]+$", "", part) + rng.choice(CASUAL), 0))
    for _ in range(3 if every else rng.random() < 0.75):
        c = _cut(t, rng, spikes.get(source, []))
        if c:
            texts.append((c + rng.choice(MARKS), 1))
    return texts


def train(texts: list[tuple[str, str, str | None]], spikes: dict[str | None, list[int]], counts: np.ndarray, every: bool = True, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from intact texts (id, text, source), and how often each feature occurs; a text is seen with the counts of the other half."""
    others = [Endings(counts=counts[1 - h]) for h in (0, 1)]
    rng, made, limit, halves, y = random.Random(), [], [], [], []
    for key, t, s in sorted(texts, key=lambda x: (x[0] or "", x[1], x[2] or "")):
        rng.seed(zlib.crc32(f"{seed}|{key}|{t}".encode("utf-8", "surrogatepass")))
        where = half(t)
        for x, label in examples(t, s, spikes, rng, every):
            limit.append(place(len(x), s, spikes) if label or rng.random() < 0.97 else "at")
            made.append(x)
            halves.append(where)
            y.append(label)
    if not made:
        return np.zeros(WIDTH), np.zeros(WIDTH, np.int64)
    x = encoded(made, limit, others, halves)
    seen, w = x.seen(WIDTH), np.zeros(WIDTH)
    used = x.packed()
    w[used] = fit(x, np.array(y, float), len(used))  # places without a feature stay 0
    return w, seen


def learned(intact: DataFrame, key: str, text: str, source: str, spikes: dict[str | None, list[int]], counts: np.ndarray, n: int, group: int) -> tuple[np.ndarray, int]:
    """Weights from all ``n`` intact texts, and how many were trained on."""
    groups = -(-n // group)
    known = intact.sparkSession.sparkContext.broadcast((packed(counts), spikes))

    def run(t: pa.Table) -> pa.Table:
        counts, spikes = known.value
        w, seen = train(list(zip(*(c.to_pylist() for c in t.columns[1:]), strict=True)), spikes, unpacked(*counts), groups == 1)
        at = np.flatnonzero(seen)
        return pa.table({"place": pa.array(np.append(at, -1)), "sum": pa.array(np.append(w[at] * seen[at], 0.0)), "n": pa.array(np.append(seen[at], t.num_rows))})

    which = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(groups)).alias("part")
    each = intact.select(which, F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    found = each.repartition(groups, "part").groupBy("part").applyInArrow(run, "place long, sum double, n long").groupBy("place").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).toArrow()
    at, sums, times = (found.column(c).to_numpy() for c in ("place", "sum", "n"))
    known.destroy()
    w = np.zeros(WIDTH)
    w[at[at >= 0]] = sums[at >= 0] / times[at >= 0]
    return w, int(times[at < 0].sum())


def scores(df: DataFrame, key: str, text: str, source: str, group: int = GROUP) -> DataFrame:
    """key, source, score (0 to 1: how likely the text was cut) of every record, repeated keys included."""
    spark = df.sparkSession
    rows = df.select(key, text, source)
    spikes = limits(rows, text, source)
    intact = rows.filter(F.col(text).rlike(_INTACT) & (F.length(text) >= 20))
    n, counts = counted(intact, text)
    w = learned(intact, key, text, source, spikes, counts, n, group)[0] if n else np.zeros(WIDTH)
    used = np.flatnonzero(w)
    model = spark.sparkContext.broadcast((used.astype(np.int32), w[used].astype(np.float32), packed(counts.sum(axis=0)), spikes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values, counts, spikes = model.value
        known = Endings(counts=unpacked(*counts))
        w = np.zeros(WIDTH)
        w[places] = values
        for b in batches:
            out = np.zeros(b.num_rows)
            texts, sources = b.column(1).to_pylist(), b.column(2).to_pylist()
            at = [i for i, t in enumerate(texts) if n and t is not None and t.strip() and t.strip().lower() not in GONE]
            if at:
                x = encoded([texts[i] for i in at], [place(len(texts[i]), sources[i], spikes) for i in at], [known])
                out[at] = 1 / (1 + np.exp(-np.clip(x.dot(w), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.float64())], names=[key, source, "score"])

    kinds = dict(df.dtypes)
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{source}` {kinds[source]}, score double")
