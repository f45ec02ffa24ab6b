"""A score for abusive, hateful or sexually explicit language in every text.

A convolutional classifier of sentences, trained in numpy: a token's embedding is the sum of hashed vectors of its
word, its consonants, its mask and its letter trigrams (after undoing dots, spaces, stretched letters and figures for
letters), filters of several widths run over them, their maxima over the sentence feed one logistic unit.  A text's
score is that of its worst sentence, relative to the threshold of the sentence's language, so that 0.5 is the
threshold everywhere.  Thresholds are calibrated by language on held-out labelled sentences.

Training: the labelled sentences of ``abuse_samples``; then the distinct sentences of ``SAMPLE`` texts of the collection
(the first by a hash of the text), of which at most ``MORE`` are taken (the first by a hash of the sentence).  These have
no labels, but few of them are abusive: those with the highest scores are left out, the others are examples of what is
clean, in rounds that leave out ever fewer (``DOUBTFUL``), so that what the model wrongly suspected leaves the top, and
what it rightly suspects is never taught to be clean.

Defined cases: null, empty, blank, deleted and removed texts and sentences without a word score 0; any length of text is read whole; each row gets its own score.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import abuse_samples
from tallyforge.llm.sampling import bounded

ROWS, DIM, FILTERS, WIDTHS = 1 << 15, 24, 24, (1, 2, 3, 4)
SAMPLE, MORE, DOUBTFUL = 6000, 12_000, (0.05, 0.02, 0.012)
GONE = frozenset(("[deleted]", "[removed]"))
CACHE = 200_000
SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_DOTTED = re.compile(r"(?<![\w.])(?:\w[.\-_*]){2,}\w(?!\w)")
_SPACED = re.compile(r"(?<!\S)(?:\w ){3,}\w(?!\w)")
_TOKEN = re.compile(r"[\w#*@$]+(?:['’][\w]+)?|[!?]")
_UNLEET = str.maketrans("4310578@$", "aeiostbas")
_STRETCH = re.compile(r"(.)\1{2,}")
_MAIL = re.compile(r"[\w.+\-]+ ?@ ?[\w\-]+(?:\.[\w\-]+)+|https?://\S+")
_MASK = re.compile(r"[#*@$]")
_VOWELS = re.compile(r"[aeiouáéíóúàèùâêîôûäöüy?]")
#: Cyrillic and Greek letters that look like Latin ones, and characters that nobody sees.
_ALIKE = str.maketrans("аеорсухіјѕԁһκοαερτυνАЕОРСТХВНКМІ", "aeopcyxijsdhkoaeptuvAEOPCTXBHKMI", "\u200b\u200c\u200d\u2060\ufeff\u00ad")
#: Words that tell the languages apart.
LANGUAGE = {
    "en": frozenset("the and is you that it of to with your i was for my a on are what this not have be".split()),
    "de": frozenset("der die das und ist du nicht ich es ein eine mit von auf hat was sich dir dich ihr seid wir zu den im am".split()),
    "fr": frozenset("le la les et est tu pas je un une des du de que ce il sur dans ta ton espèce sale vous nous en au".split()),
    "es": frozenset("el la los y es no un una de que te tu al por con se lo eres en las su del muy".split()),
}


def tokens(sentence: str) -> list[str]:
    if not sentence.isascii():
        sentence = unicodedata.normalize("NFKC", sentence).translate(_ALIKE)
    t = _SPACED.sub(lambda m: m.group().replace(" ", ""), _MAIL.sub(" handle ", sentence))
    t = _DOTTED.sub(lambda m: re.sub(r"[.\-_]", "", m.group()), t)
    return ["handle" if x[0] == "@" and len(x) > 3 and x[1:].replace("_", "").isalpha() else x.lower() for x in _TOKEN.findall(t)]


def language(words: list[str]) -> str:
    return max(LANGUAGE, key=lambda k: sum(w in LANGUAGE[k] for w in words))


def _bucket(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % ROWS


def parts(t: str) -> list[int]:
    """Hashed parts of a token."""
    w = _STRETCH.sub(r"\1", t)
    masked = bool(_MASK.search(w))
    if any(c.isalpha() for c in w) and not w.isalpha():
        w = w.translate(_UNLEET) if not masked else w
    if w.isdigit():
        return [_bucket("number")]
    out = [f"w{w}"]
    bare = _MASK.sub("?", w)
    if len(w) >= 4:
        bones = _VOWELS.sub("", bare)
        if len(bones) >= 3:
            out.append(f"b{bones}")
    if masked:
        out += ["masked", f"m{bare[0]}{bare[-1]}{len(bare)}"]
    elif len(w) >= 4:
        out.append(f"p{w[:4]}")
    if not masked and len(w) >= 4:
        x = f"<{w}>"
        out += [f"t{x[i : i + 3]}" for i in range(len(x) - 2)]
    return [_bucket(x) for x in out]


class Net:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {"e": (r.normal(0, 0.12, (ROWS, DIM))).astype(np.float32), "o": r.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32)}
        for k in WIDTHS:
            self.p[f"w{k}"] = r.normal(0, 0.25 / k**0.5, (k, DIM, FILTERS)).astype(np.float32)
            self.p[f"b{k}"] = np.zeros(FILTERS, np.float32)
        self.thresholds = dict.fromkeys(LANGUAGE, 0.5)

    def train(self, rows: list[list[str]], y: np.ndarray, epochs: int, rate: float = 0.004, seed: int = 1) -> None:
        """Adam on the log loss over batches of sentences of like length."""
        vocab: dict[str, int] = {}
        coded = [[vocab.setdefault(t, len(vocab)) for t in r] or [vocab.setdefault("", len(vocab))] for r in rows]
        feats = [parts(t) for t in vocab]
        flat = np.array([f for fs in feats for f in fs])
        owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        scale = np.array([1 / len(f) ** 0.5 for f in feats], np.float32)
        starts = np.concatenate([[0], np.cumsum([len(f) for f in feats])[:-1]])
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, size = 0, 256
        order = np.argsort([len(c) for c in coded], kind="stable")
        batches = [order[i : i + size] for i in range(0, len(order), size)]
        for _ in range(epochs):
            for bi in rng.permutation(len(batches)):
                b = batches[bi]
                most = max(max(len(coded[i]) for i in b), max(WIDTHS))
                idx = np.full((len(b), most), -1)
                for r, i in enumerate(b):
                    idx[r, : len(coded[i])] = coded[i]
                used, inv = np.unique(idx, return_inverse=True)
                inv = inv.reshape(idx.shape)
                emb = np.zeros((len(used), DIM), np.float32)
                real = used >= 0
                ids = used[real]
                spans = [np.arange(starts[i], starts[i] + len(feats[i])) for i in ids]
                cat = np.concatenate(spans)
                own = np.repeat(np.flatnonzero(real), [len(s) for s in spans])
                sc = scale[owner[cat]][:, None]
                rows_e = self.p["e"][flat[cat]] * sc
                np.add.at(emb, own, rows_e)
                x = emb[inv]
                grads: dict[str, np.ndarray] = {}
                hs, keep = [], []
                for k in WIDTHS:
                    w = self.p[f"w{k}"]
                    n = most - k + 1
                    z = sum(x[:, j : j + n] @ w[j] for j in range(k)) + self.p[f"b{k}"]
                    a = z.argmax(1)
                    top = np.take_along_axis(z, a[:, None], 1)[:, 0]
                    hs.append(np.maximum(top, 0))
                    keep.append((a, top > 0))
                h = np.concatenate(hs, 1)
                drop = (rng.random(h.shape) < 0.8).astype(np.float32) / 0.8
                h = h * drop
                p = 1 / (1 + np.exp(-np.clip(h @ self.p["o"] + self.p["c"], -30, 30)))
                d = ((p - y[b]) / len(b)).astype(np.float32)
                grads["o"], grads["c"] = h.T @ d, np.array([d.sum()], np.float32)
                dh = d[:, None] * self.p["o"] * drop
                dx = np.zeros_like(x)
                rows_i = np.arange(len(b))[:, None]
                for q, k in enumerate(WIDTHS):
                    a, on = keep[q]
                    g = dh[:, q * FILTERS : (q + 1) * FILTERS] * on
                    grads[f"b{k}"] = g.sum(0)
                    gw = np.zeros_like(self.p[f"w{k}"])
                    for j in range(k):
                        at = x[rows_i, a + j]  # batch, filter, dim
                        gw[j] = np.einsum("bfd,bf->df", at, g)
                        np.add.at(dx, (np.broadcast_to(rows_i, a.shape), a + j), g[:, :, None] * self.p[f"w{k}"][j].T)
                    grads[f"w{k}"] = gw
                demb = np.zeros_like(emb)
                np.add.at(demb, inv.ravel(), dx.reshape(-1, DIM))
                touched, back = np.unique(flat[cat], return_inverse=True)
                ge = np.zeros((len(touched), DIM), np.float32)
                np.add.at(ge, back, demb[own] * sc)
                step += 1
                fix = (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.001 * (g * g - v2[k])
                    self.p[k] -= rate * fix * m[k] / (np.sqrt(v2[k]) + 1e-8)
                me = m["e"][touched] = m["e"][touched] * 0.9 + 0.1 * ge
                ve = v2["e"][touched] = v2["e"][touched] * 0.999 + 0.001 * ge * ge
                self.p["e"][touched] -= rate * fix * me / (np.sqrt(ve) + 1e-8)

    def scores(self, rows: list[list[str]], code: dict[str, int] | None = None) -> np.ndarray:
        """The chance of each sentence (a list of tokens); each distinct token's filter responses are worked out once."""
        if not rows:
            return np.zeros(0)
        vocab: dict[str, int] = {"": 0}
        pad = max(WIDTHS) - 1
        stream: list[int] = []
        starts = []
        for r in rows:
            starts.append(len(stream))
            stream += [vocab.setdefault(t, len(vocab)) for t in r] or [0]
            stream += [0] * pad
        feats = [parts(t) if t else [] for t in vocab]
        emb = np.zeros((len(vocab), DIM), np.float32)
        flat = np.array([f for fs in feats for f in fs], int)
        owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        scale = np.array([1 / max(1, len(f)) ** 0.5 for f in feats], np.float32)
        np.add.at(emb, owner, self.p["e"][flat] * scale[owner][:, None])
        codes = np.array(stream)
        begin = np.array(starts)
        total = np.full(len(rows), self.p["c"][0], np.float32)
        length = np.diff(np.append(begin, len(codes)))
        offset = np.arange(len(codes)) - np.repeat(begin, length)
        for q, k in enumerate(WIDTHS):
            z = (emb @ self.p[f"w{k}"][0])[codes]
            for j in range(1, k):
                z[:-j] += (emb @ self.p[f"w{k}"][j])[codes[j:]]
            z += self.p[f"b{k}"]
            # Windows beyond the last one that training saw belong to no sentence.
            last = np.maximum(np.repeat(length, length) - pad, max(WIDTHS)) - k
            z[offset > last] = -np.inf
            top = np.maximum(np.maximum.reduceat(z, begin, axis=0), 0)
            total += top @ self.p["o"][q * FILTERS : (q + 1) * FILTERS]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def calibrate(self, rows: list[tuple[list[str], str, int]]) -> None:
        """For each language the threshold with the best F1 at one abusive sentence in thirty, in the middle of its plateau."""
        p = self.scores([r[0] for r in rows])
        for lang in LANGUAGE:
            own = np.array([r[1] == lang for r in rows])
            y = np.array([r[2] for r in rows])[own]
            s = p[own]
            grid = np.linspace(0.3, 0.85, 56)
            f1 = []
            for g in grid:
                recall, false = (s[y == 1] >= g).mean(), (s[y == 0] >= g).mean()
                f1.append(2 * recall / 30 / (recall / 30 + false * 29 / 30 + 1 / 30 + 1e-9))
            best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-3)
            self.thresholds[lang] = float(grid[best[len(best) // 2]])


def first_model(part: tuple[int, int] | None = None) -> tuple[Net, list, list]:
    """A model of the labelled sentences alone, calibrated; the rows it learned from and those held back."""
    data = [(tokens(t), lang, y) for t, lang, y in abuse_samples.sentences(part=part)]
    held, rows = data[: len(data) // 4], data[len(data) // 4 :]
    net = Net()
    net.train([r[0] for r in rows], np.array([r[2] for r in rows], np.float32), epochs=9)
    net.calibrate(held)
    return net, rows, held


@functools.lru_cache(maxsize=1)
def _first() -> tuple[Net, list, list]:
    return first_model()


def fitted(texts: list[str]) -> Net:
    """The model, with the clean sentences among ``texts`` as further examples."""
    import copy

    first, rows, held = _first()
    net = copy.deepcopy(first)
    more = sorted({s for t in texts for s in SENTENCE.split(t) if s.strip()}, key=lambda s: (zlib.crc32(s.encode("utf-8", "surrogatepass")), s))[:MORE]
    toks = [t for t in (tokens(s) for s in more) if t]
    for share in DOUBTFUL if toks else ():
        ranked = np.argsort(net.scores(toks), kind="stable")
        everything = rows + [(toks[i], "", 0) for i in sorted(ranked[: int(len(toks) * (1 - share))].tolist())]
        net.train([r[0] for r in everything], np.array([r[2] for r in everything], np.float32), epochs=2, rate=0.002)
    net.calibrate(held)
    return net


class Scorer:
    """Scores of texts; a sentence seen before is not scored again."""

    def __init__(self, net: Net):
        self.net, self.seen = net, {}

    def __call__(self, texts: list[str | None]) -> list[float]:
        if len(self.seen) > CACHE:
            self.seen.clear()
        split = [SENTENCE.split(t) if t and not t.isspace() and t.strip().lower() not in GONE else [] for t in texts]
        new = list(dict.fromkeys(s for ss in split for s in ss if s not in self.seen))
        for k in range(0, len(new), 4000):
            part = new[k : k + 4000]
            toks = [tokens(s) for s in part]
            for s, t, p in zip(part, toks, self.net.scores(toks).tolist(), strict=True):
                g = self.net.thresholds[language(t)]
                self.seen[s] = 0.0 if not t else 0.5 * p / g if p < g else 0.5 + 0.5 * (p - g) / (1 - g)
        return [max((self.seen[s] for s in ss), default=0.0) for ss in split]


def scores(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, score (0.5: the threshold) of every row."""
    spark = df.sparkSession
    rows = df.select(text, *keys)
    some = bounded(rows.filter(F.length(F.trim(text)) > 0).select(text), [text], SAMPLE)
    model = spark.sparkContext.broadcast(fitted([r[0] for r in some]))  # of fixed size
    kinds = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)
    made: dict[int, Scorer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = made.get(0) or made.setdefault(0, Scorer(model.value))
        for big in batches:
            for b in (big.slice(k, 2000) for k in range(0, big.num_rows, 2000)):
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score(b.column(0).to_pylist()), pa.float64())], names=[*keys, "score"])

    return rows.mapInArrow(run, f"{kinds}, score double")
