"""Personal data in free text by a skip-chain conditional random field.

Labels: none, email, phone, id_number, address, name.  A token's potentials come from its word, shape, ends and rarity,
the digits of the number it belongs to, how far the next @ and the next figure are, its neighbours and the pairs of their classes.
Neighbouring labels share a transition potential.  Rare words and numbers that come again in a document, alike or similar
(the same consonants, the same last four digits), share a skip potential; each is linked to the one before it.

Chain and skip weights are learnt together by maximum likelihood, with sum-product messages over chain and skip edges
(the expectations of a graph with loops are those its messages settle on).  Labels are found by max-product messages:
exact on the chains, and passed over the skip edges until none changes by more than ``SETTLED``; ``ROUNDS`` bounds the
passes, and ``influence`` reports the documents that had not settled by then, and those whose labels the edges change.

Tokens whose margin for 'none' exceeds all that transitions and skip edges could add keep that label whatever their
neighbours do, so the chain falls apart at them without loss and messages are passed over the short runs between.

Rarity: words in at least ``COMMON`` of the documents are common; there are at most (mean distinct words of a document)
/ ``COMMON`` of them, counted over all documents.

Defined cases: null, empty and blank texts have no entity; any length of text is read whole; repeated records give one
row a kind; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import pii_samples

LABELS = ["", "email", "phone", "id_number", "address", "name"]
_OF = {"": 0, "email": 1, "phone": 2, "id": 3, "address": 4, "name": 5}
COMMON = 0.002
WIDTH = 1 << 17
ROUNDS, SETTLED = 50, 1e-3
FAR, DIGITS = 8, 18  # how far an @ is seen, and up to how many digits of a number are told apart
TOKEN = re.compile(r"[^\W_]+(?:_[^\W_]+)*|[^\w\s]|_")
_JVM_WORD = r"(?U)[^\p{L}]+"
_FIRST = frozenset(x.lower() for x in pii_samples.FIRST)
_SEEN = ("at", "dig")
_JOINT = frozenset("-./()+")
_VOWELS = str.maketrans("", "", "aeiouyáéíóúàèùâêîôûäöü")


def shape(t: str, common: bool) -> str:
    if t.isdigit():
        return f"d{min(len(t), 12)}"
    if t.isalpha():
        s = "x" if t.islower() else "Xx" if len(t) > 1 and t[1:].islower() else ("X" if len(t) == 1 else "XX") if t.isupper() else "xX"
        return s + ("" if common or len(t) == 1 else "~")
    if len(t) == 1:
        return t
    s = re.sub(r"\d", "d", re.sub(r"[^\W\d_]", "X", t))
    return re.sub(r"(X{3})X+", r"\1+", s) if len(s) <= 13 else "mix"


def _place(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % WIDTH


def _own(t: str, s: str) -> list[str]:
    w = t.lower()
    out = [f"w={w}", f"s={s}"]
    if t.isalpha() and len(t) > 2:
        out += [f"p={w[:3]}", f"e3={w[-3:]}", f"e4={w[-4:]}"]
    if w in _FIRST:
        out += ["given", f"given{s}"]
    return out


def _beside(t: str, s: str, at: int) -> list[str]:
    out = [f"{at}w={t.lower()}", f"{at}s={s}"]
    if t.lower() in _FIRST:
        out.append(f"{at}given")
    return out


def link_key(t: str, common: bool) -> str | None:
    """What linked tokens have in common; None for those that aren't linked."""
    if t.isdigit():
        return f"#{t[-4:]}" if len(t) >= 4 else None
    if t.isalpha():
        if common or len(t) < 4:
            return None
        w = t.lower()
        bones = w[0] + w[1:].translate(_VOWELS)
        return bones if len(bones) >= 3 else w
    return t.lower() if len(t) >= 5 else None


def links(docs: np.ndarray, keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Skip edges (from, to, kind) of a stream of tokens, by the numbers of their keys (-1: none) and words: each token and the one before it with its key in its document; kind 0 if they are alike, 1 if similar."""
    own = np.flatnonzero(keys >= 0)
    own = own[np.lexsort((own, keys[own], docs[own]))]
    follows = (docs[own[1:]] == docs[own[:-1]]) & (keys[own[1:]] == keys[own[:-1]])
    i, j = own[:-1][follows], own[1:][follows]
    return i, j, (words[i] != words[j]).astype(int)


def _numbers(xs: list[str | None], known: dict[str, int]) -> np.ndarray:
    return np.array([-1 if x is None else known.setdefault(x, len(known)) for x in xs], int)


class Crf:
    """Weights of hashed features, of class pairs, of transitions and of skip edges."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, skip: np.ndarray):
        self.w, self.trans, self.skip = weights.astype(np.float32), trans.astype(np.float32), skip.astype(np.float32)
        # Most that a message can move another label against 'none'.
        self.pull = float(max(0.0, (self.skip[:, :, 1:] - self.skip[:, :, :1]).max()))
        # Most that another label could gain over 'none' by the steps to and from its neighbours: beyond it a token is
        # 'none' whatever its open neighbours are; [left open, right open], neighbours that aren't open being 'none'.
        gain = trans[:, 1:, None] + trans[None, 1:, :] - trans[:, :1, None] - trans[None, :1, :]  # before, own, after
        self.bound = np.array([[gain[0, :, 0].max(), gain[0].max()], [gain[:, :, 0].max(), gain.max()]], np.float32)

    def vector(self, names: list[str]) -> np.ndarray:
        return self.w[[_place(n) for n in names]].sum(0)


class Tables:
    """Potentials of every token and class pair met so far; a token's are worked out once."""

    LIMIT = 400_000

    def __init__(self, crf: Crf, common: frozenset[str]):
        self.crf, self.common = crf, common
        of = lambda name, n: np.stack([np.zeros(6, np.float32), *[crf.w[_place(f"{name}{k}")] for k in range(1, n + 1)]])
        self.numbers, self.far = of("nd", DIGITS), of("nodig", 1)
        self.seen = {name: (of(f"{name}ahead", FAR), of(f"{name}behind", FAR)) for name in _SEEN}
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.words: list[str] = []
        self.low: list[str] = []
        self.keys: list[str | None] = []
        self.key_ids: dict[str, int] = {}
        self.word_ids: dict[str, int] = {}
        self.cls: list[int] = []
        self.shape_code: dict[str, int] = {}
        self.shapes: list[str] = []
        self.rows: list[np.ndarray] = []  # own, -2, -1, +1, +2
        self.size = 0
        self.pairs = np.zeros((3, 0, 0, 6), np.float32)
        self.add("\n\n")

    def add(self, t: str) -> int:
        s = "end" if t == "\n\n" else shape(t, t.lower() in self.common)
        k = self.shape_code.get(s)
        if k is None:
            k = self.shape_code[s] = len(self.shapes)
            self.shapes.append(s)
        c = self.code[t] = len(self.words)
        self.words.append(t)
        self.low.append(t.lower())
        self.keys.append(None if t == "\n\n" else link_key(t, t.lower() in self.common))
        self.cls.append(k)
        v = self.crf.vector
        self.rows.append(np.stack([v(_own(t, s)), *[v(_beside(t, s, at)) for at in (-2, -1, 1, 2)]]))
        return c

    def wide(self, codes: np.ndarray) -> np.ndarray:
        """What lies beyond the neighbours: the number's digits, the nearest @ and the nearest figure."""
        nd = digits_of_numbers(self.digits[codes], self.joint[codes])
        u = self.numbers[nd]
        end_ahead, end_behind = steps_to(np.flatnonzero(codes == 0), len(codes))
        at = self.code.get("@")
        for name, marks in (("at", codes == at if at is not None else np.zeros(len(codes), bool)), ("dig", self.digits[codes] > 0)):
            ahead, behind = steps_to(np.flatnonzero(marks), len(codes))
            ahead = np.where((end_ahead > 0) & (end_ahead < ahead), 0, ahead)  # not beyond the document
            behind = np.where((end_behind > 0) & (end_behind < behind), 0, behind)
            u = u + self.seen[name][0][ahead] + self.seen[name][1][behind]
        return u + self.far[((ahead == 0) & (behind == 0) & (nd == 0)).astype(int)]

    def encode(self, tokens: list[str]) -> list[int]:
        get = self.code.get
        out = []
        for t in tokens:
            c = get(t)
            out.append(self.add(t) if c is None else c)
        return out

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.size != len(self.words):
            self.table = np.stack(self.rows)
            self.classes = np.array(self.cls)
            self.key_of, self.word_of = _numbers(self.keys, self.key_ids), _numbers(self.low, self.word_ids)
            self.digits = np.array([0 if w == "\n\n" else sum(map(str.isdigit, w)) for w in self.low])
            self.joint = np.array([w in _JOINT for w in self.low])
            n, old = len(self.shapes), self.pairs.shape[1]
            if n > old:
                pairs = np.zeros((3, n, n, 6), np.float32)
                pairs[:, :old, :old] = self.pairs
                for a in range(n):
                    for b in range(n):
                        if a >= old or b >= old:
                            x, y = self.shapes[a], self.shapes[b]
                            pairs[0, a, b] = self.crf.w[_place(f"L{x}|{y}")]
                            pairs[1, a, b] = self.crf.w[_place(f"R{x}|{y}")]
                            pairs[2, a, b] = self.crf.w[_place(f"B{x}|{y}")]
                self.pairs = pairs
            self.size = len(self.words)
        return self.table, self.classes, self.pairs

    def unary(self, codes: np.ndarray) -> np.ndarray:
        """Potentials of a stream of tokens with two ends between documents."""
        table, classes, pairs = self.arrays()
        u = table[codes, 0] + self.wide(codes)
        u[2:] += table[codes[:-2], 1]
        u[1:] += table[codes[:-1], 2]
        u[:-1] += table[codes[1:], 3]
        u[:-2] += table[codes[2:], 4]
        c = classes[codes]
        u[1:] += pairs[0][c[:-1], c[1:]]
        u[:-1] += pairs[1][c[:-1], c[1:]]
        u[1:-1] += pairs[2][c[:-2], c[2:]]
        return u


def digits_of_numbers(digits: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """For each token how many digits the number has that it belongs to: a run of tokens with digits and marks that join them; 0 outside numbers."""
    on = (digits > 0) | joint
    run = np.cumsum(np.append(True, on[1:] != on[:-1])) - 1
    n = np.bincount(run, digits)[run]
    return np.where(on, np.minimum(n, DIGITS), 0).astype(int)


def steps_to(marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place how far the next and the last of ``marks`` are, 0 where none is within FAR."""
    at = np.arange(size)
    if not len(marks):
        return np.zeros(size, int), np.zeros(size, int)
    k = np.searchsorted(marks, at)
    ahead = np.where(k < len(marks), marks[np.minimum(k, len(marks) - 1)] - at, FAR + 1)
    behind = np.where(k > 0, at - marks[np.maximum(k - 1, 0)], FAR + 1)
    return np.where((ahead >= 1) & (ahead <= FAR), ahead, 0), np.where((behind >= 1) & (behind <= FAR), behind, 0)


def _training(texts: list, common: frozenset[str] | None = None) -> tuple[list[list[str]], list[list[int]], frozenset[str]]:
    """Tokens and labels of labelled texts, and the words that are common in what is no entity."""
    docs, labels = [], []
    carrier: dict[str, int] = {}
    for parts in texts:
        toks, labs = [], []
        for text, kind in parts:
            found = TOKEN.findall(text)
            toks += found
            labs += [_OF[kind]] * len(found)
            if not kind:
                for t in {x.lower() for x in found}:
                    carrier[t] = carrier.get(t, 0) + 1
        docs.append(toks)
        labels.append(labs)
    return docs, labels, common if common is not None else frozenset(t for t, n in carrier.items() if n >= 8 and t.isalpha())


class _Batch:
    """Labelled texts of like length as arrays: features of each token, places in padded texts, skip edges."""

    def __init__(self, docs: list[list[str]], labels: list[list[int]], common: frozenset[str], place, rng: np.random.Generator):
        most = max(map(len, docs))
        feats: list[int] = []
        ends: list[int] = []
        self.idx = np.full((len(docs), most), -1)
        gold: list[int] = []
        keys: list[str | None] = []
        words: list[str] = []
        of: list[int] = []
        for r, d in enumerate(docs):
            # What is common elsewhere may be rare in a collection: some words count as rare here and there.
            s = [shape(t, t.lower() in common and x > 0.15) for t, x in zip(d, rng.random(len(d)), strict=True)]
            nd = digits_of_numbers(np.array([sum(map(str.isdigit, t)) for t in d]), np.array([t in _JOINT for t in d]))
            where = {name: np.array([k for k, t in enumerate(d) if f(t)], int) for name, f in (("at", lambda t: t == "@"), ("dig", lambda t: any(map(str.isdigit, t))))}
            steps = [(f"{name}{side}", v) for name in _SEEN for side, v in zip(("ahead", "behind"), steps_to(where[name], len(d)), strict=True)]
            steps = [("nd", nd), *steps, ("nodig", ((steps[2][1] == 0) & (steps[3][1] == 0) & (nd == 0)).astype(int))]
            t_, s_ = ["\n\n", "\n\n", *d, "\n\n", "\n\n"], ["end", "end", *s, "end", "end"]
            for k in range(2, len(d) + 2):
                self.idx[r, k - 2] = len(ends)
                n = _own(t_[k], s_[k])
                for at in (-2, -1, 1, 2):
                    n += _beside(t_[k + at], s_[k + at], at)
                n += [f"L{s_[k - 1]}|{s_[k]}", f"R{s_[k]}|{s_[k + 1]}", f"B{s_[k - 1]}|{s_[k + 1]}"]
                n += [f"{name}{v[k - 2]}" for name, v in steps if v[k - 2]]
                feats += [place(x) for x in n]
                ends.append(len(feats))
            gold += labels[r]
            keys += [link_key(t, t.lower() in common) for t in d]
            words += [t.lower() for t in d]
            of += [r] * len(d)
        self.used, self.flat = np.unique(feats, return_inverse=True)
        self.starts = np.concatenate([[0], ends[:-1]]).astype(int)
        self.token = np.repeat(np.arange(len(ends)), np.diff(np.append(self.starts, len(feats))))
        y = np.array(gold)
        self.want = np.eye(6)[y]
        self.follow = np.zeros((6, 6))
        for k in range(1, most):
            on = self.idx[:, k] >= 0
            np.add.at(self.follow, (y[self.idx[on, k - 1]], y[self.idx[on, k]]), 1)
        self.edges = links(np.array(of), _numbers(keys, {}), _numbers(words, {}))
        self.linked = np.zeros((2, 6, 6))
        i, j, kind = self.edges
        np.add.at(self.linked, (kind, y[i], y[j]), 1)


def _loopy(u: np.ndarray, t: np.ndarray, skip: np.ndarray, b: _Batch, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label chances, expected neighbouring pairs and expected linked pairs, by messages over chain and skip edges."""
    i, j, kind = b.edges
    p, et = _expected(u, t, b.idx)
    es = np.zeros_like(skip)
    if not len(i):
        return p, et, es
    to_j, to_i = np.zeros((len(i), 6)), np.zeros((len(i), 6))
    e = np.exp(skip)[kind]
    for _ in range(rounds):
        low = np.log(p + 1e-12)
        ci, cj = low[i] - to_i, low[j] - to_j
        ci, cj = ci - ci.max(1, keepdims=True), cj - cj.max(1, keepdims=True)
        new_j = np.log(np.einsum("ey,eyz->ez", np.exp(ci), e) + 1e-12)
        new_i = np.log(np.einsum("ez,eyz->ey", np.exp(cj), e) + 1e-12)
        new_j, new_i = new_j - new_j.max(1, keepdims=True), new_i - new_i.max(1, keepdims=True)
        moved = max(np.abs(new_j - to_j).max(), np.abs(new_i - to_i).max())
        to_j, to_i = new_j, new_i
        x = u.copy()
        np.add.at(x, j, to_j)
        np.add.at(x, i, to_i)
        p, et = _expected(x, t, b.idx)
        if moved < 0.02:
            break
    low = np.log(p + 1e-12)
    pair = np.exp(low[i] - to_i - (low[i] - to_i).max(1, keepdims=True))[:, :, None] * e * np.exp(low[j] - to_j - (low[j] - to_j).max(1, keepdims=True))[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    np.add.at(es, kind, pair)
    return p, et, es


def fitted(texts: list, epochs: int = 8, rate: float = 0.3, l2: float = 1e-6, common: frozenset[str] | None = None) -> Crf:
    """Maximum likelihood on labelled texts: Adagrad over batches of texts of like length, chain and skip weights together."""
    docs, labels, common = _training(texts, common)
    order = np.argsort([len(d) for d in docs], kind="stable")
    place = functools.lru_cache(None)(_place)
    rng = np.random.default_rng(5)
    batches = [_Batch([docs[i] for i in g], [labels[i] for i in g], common, place, rng) for g in np.array_split(order[[len(docs[i]) > 0 for i in order]], 40) if len(g)]
    w, t, s = np.zeros((WIDTH, 6)), np.zeros((6, 6)), np.zeros((2, 6, 6))
    hw, ht, hs = np.full_like(w, 1e-4), np.full_like(t, 1e-4), np.full_like(s, 1e-4)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            u = np.add.reduceat(w[b.used][b.flat], b.starts, axis=0)
            p, et, es = _loopy(u, t, s, b)
            n = len(b.idx)
            d = (p - b.want) / n
            gw = np.stack([np.bincount(b.flat, d[b.token, c], len(b.used)) for c in range(6)], 1) + l2 * w[b.used]
            gt = (et - b.follow) / n + l2 * t
            gs = (es - b.linked) / n
            gs = (gs + gs.transpose(0, 2, 1)) / 2 + 1e-4 * s
            hw[b.used] += gw * gw
            ht += gt * gt
            hs += gs * gs
            w[b.used] -= rate * gw / np.sqrt(hw[b.used])
            t -= rate * gt / np.sqrt(ht)
            s -= 0.3 * rate * gs / np.sqrt(hs)
    return Crf(w, t, s)


@functools.lru_cache(maxsize=1)
def trained() -> Crf:
    return fitted(pii_samples.sentences())


def _expected(u: np.ndarray, t: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label chances of every token and expected label pairs, by forward and backward sums over padded sentences."""
    on = idx >= 0
    n, most = idx.shape
    x = u[np.maximum(idx, 0)]
    a, b = np.zeros((most, n, 6)), np.zeros((most, n, 6))
    a[0] = x[:, 0]
    e = np.exp(t)

    def log_sum(m: np.ndarray, step: np.ndarray) -> np.ndarray:
        top = m.max(1, keepdims=True)
        return np.log(np.exp(m - top) @ step) + top

    for k in range(1, most):
        a[k] = np.where(on[:, k, None], log_sum(a[k - 1], e) + x[:, k], a[k - 1])
    for k in range(most - 2, -1, -1):
        b[k] = np.where(on[:, k + 1, None], log_sum(x[:, k + 1] + b[k + 1], e.T), 0)
    z = a[-1].max(1)
    z = z + np.log(np.exp(a[-1] - z[:, None]).sum(1))
    p, et = np.zeros((len(u), 6)), np.zeros((6, 6))
    for k in range(most):
        ok = on[:, k]
        p[idx[ok, k]] = np.exp(a[k][ok] + b[k][ok] - z[ok, None])
        if k:
            left, right = a[k - 1][ok], x[ok, k] + b[k][ok] - z[ok, None]
            shift = left.max(1, keepdims=True)
            et += (np.exp(left - shift)).T @ np.exp(np.minimum(right + shift, 50))
    return p, et * e


def _max_marginals(u: np.ndarray, starts: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Max-marginals of runs of tokens between labels 'none'; u holds the runs one after the other."""
    out = np.empty_like(u)
    for n in np.unique(length):  # runs of equal length together
        own = starts[length == n]
        idx = own[:, None] + np.arange(n)
        x = u[idx]
        a, b = np.empty_like(x), np.empty_like(x)
        a[:, 0] = trans[0] + x[:, 0]
        for k in range(1, n):
            a[:, k] = (a[:, k - 1, :, None] + trans).max(1) + x[:, k]
        b[:, n - 1] = trans[:, 0]
        for k in range(n - 2, -1, -1):
            b[:, k] = (trans + (x[:, k + 1] + b[:, k + 1])[:, None, :]).max(2)
        out[idx] = a + b
    return out


def decode(crf: Crf, u: np.ndarray, doc: np.ndarray, codes: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the stream, and the documents whose messages had not settled."""
    labels = np.zeros(len(u), np.int8)
    i, j, kind = edges
    linked = np.zeros(len(u), bool)
    linked[i] = linked[j] = True
    margin = u[:, 0] - u[:, 1:].max(1)
    extra = (np.bincount(i, minlength=len(u)) + np.bincount(j, minlength=len(u))) * crf.pull
    open_ = (margin <= crf.bound[1, 1] + extra) & (codes != 0)
    active = np.flatnonzero(open_)
    while len(active):  # a token that is certain closes its neighbours' sides, which may make them certain
        joined = np.diff(active) == 1
        left, right = np.append(False, joined).astype(int), np.append(joined, False).astype(int)
        keep = margin[active] <= crf.bound[left, right] + extra[active]
        if keep.all():
            break
        active = active[keep]
    none = np.zeros(0, int)
    if not len(active):
        return labels, none
    new = np.append(True, (np.diff(active) > 1) | (np.diff(doc[active]) > 0))
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(active)))
    x = u[active].astype(np.float32)
    place = np.full(len(u), -1)
    place[active] = np.arange(len(active))
    # An end that is certain sends what 'none' sends, once and for all.
    i, j = place[i], place[j]
    fixed = crf.skip[kind, 0]
    for here, there in ((i, j), (j, i)):
        lone = (here >= 0) & (there < 0)
        np.add.at(x, here[lone], fixed[lone] - fixed[lone].max(1, keepdims=True))
    both = (i >= 0) & (j >= 0)
    i, j, kind = i[both], j[both], kind[both]
    belief = _max_marginals(x, starts, length, crf.trans)
    moving = none
    if len(i):
        run = np.repeat(np.arange(len(starts)), length)
        s = crf.skip[kind]
        to_j, to_i = np.zeros((len(i), 6), np.float32), np.zeros((len(i), 6), np.float32)
        touched = np.unique(np.concatenate([run[i], run[j]]))  # only these runs change
        part = np.isin(run, touched)
        own = np.flatnonzero(part)
        at = np.full(len(x), -1)
        at[own] = np.arange(len(own))
        part_starts, part_length = at[starts[touched]], length[touched]
        for k in range(ROUNDS):
            ci, cj = belief[i] - to_i, belief[j] - to_j
            new_j, new_i = (ci[:, :, None] + s).max(1), (cj[:, None, :] + s).max(2)
            new_j, new_i = new_j - new_j.max(1, keepdims=True), new_i - new_i.max(1, keepdims=True)
            if k >= 10:  # messages that go round and round are calmed
                new_j, new_i = (new_j + to_j) / 2, (new_i + to_i) / 2
            change = np.maximum(np.abs(new_j - to_j).max(1), np.abs(new_i - to_i).max(1)) > SETTLED
            moving = i[change]
            to_j, to_i = new_j, new_i
            y = x.copy()
            np.add.at(y, j, to_j)
            np.add.at(y, i, to_i)
            belief[own] = _max_marginals(y[own], part_starts, part_length, crf.trans)
            if not len(moving):
                break
    labels[active] = belief.argmax(1)
    return labels, np.unique(doc[active[moving]]) if len(moving) else none


class Finder:
    """Spans of personal data in lists of texts."""

    def __init__(self, crf: Crf, common: frozenset[str]):
        self.tables = Tables(crf, common)

    def labels(self, texts: list[str | None], skip: bool = True) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray, tuple, np.ndarray]:
        """Labels, codes, each text's first place, each place's text (from 1), skip edges and texts that had not settled."""
        t = self.tables
        if len(t.words) > t.LIMIT:
            t.clear()
        stream, at, sizes = [0, 0], [], []
        for text in texts:
            toks = TOKEN.findall(text) if text else []
            at.append(len(stream))
            stream += t.encode(toks)
            sizes.append(len(toks))
            stream += [0, 0]
        codes = np.array(stream)
        doc = np.repeat(np.arange(len(texts) + 1), np.append(2, np.array(sizes, int) + 2)) if texts else np.zeros(2, int)
        u = t.unary(codes)
        edges = links(doc, t.key_of[codes], t.word_of[codes]) if skip else (np.zeros(0, int),) * 3
        got, moving = decode(t.crf, u, doc, codes, edges) if texts else (np.zeros(2, np.int8), np.zeros(0, int))
        return got, codes, at, doc, edges, moving

    def spans(self, texts: list[str | None], skip: bool = True) -> list[list[tuple[int, int, int]]]:
        """For each text, (first token, token after the last, kind)."""
        labels, _, at, doc, _, _ = self.labels(texts, skip)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        hot = np.flatnonzero(labels)
        if len(hot):
            cut = np.append(True, (np.diff(hot) > 1) | (labels[hot][1:] != labels[hot][:-1]) | (np.diff(doc[hot]) > 0))
            firsts = hot[cut]
            lasts = hot[np.append(cut[1:], True)]
            for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
                d = int(doc[a]) - 1
                out[d].append((a - at[d], b + 1 - at[d], int(labels[a])))
        return out


def common_words(df: DataFrame, text: str, share: float = COMMON) -> frozenset[str]:
    """The words (lower case letters) that at least ``share`` of the texts hold, counted over all of them."""
    texts = df.filter(F.trim(text) != "").select(text)
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower(text), _JVM_WORD))).alias("w")).groupBy("w").count()
    n = texts.count()
    return frozenset(r.w for r in words.filter((F.col("count") >= max(2, share * n)) & (F.col("w") != "")).select("w").collect())


def found(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pii_type of every record and kind of personal data in it."""
    return _run(df, keys, text, False)


def influence(df: DataFrame, text: str) -> DataFrame:
    """documents, linked, decided, unsettled: texts, those with skip edges, those whose labels the edges change, and those whose messages hadn't settled after ROUNDS."""
    rows = df.select(text)
    model = df.sparkSession.sparkContext.broadcast((trained(), common_words(rows, text)))
    made: dict[int, Finder] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = made.get(0) or made.setdefault(0, Finder(*model.value))
        n = np.zeros(4, int)
        for big in batches:
            for b in (big.slice(k, 2000) for k in range(0, big.num_rows, 2000)):
                texts = b.column(0).to_pylist()
                with_, _, _, doc, edges, moving = finder.labels(texts)
                without = finder.labels(texts, False)[0]
                n += [len(texts), len(np.unique(doc[edges[0]])), len(np.unique(doc[with_ != without])), len(moving)]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in n], names=["documents", "linked", "decided", "unsettled"])

    each = rows.mapInArrow(run, "documents long, linked long, decided long, unsettled long")
    return each.agg(*[F.sum(c).alias(c) for c in ("documents", "linked", "decided", "unsettled")])


def redacted(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, text with a placeholder such as [EMAIL] for every entity; other texts as they are."""
    return _run(df, keys, text, True)


def _run(df: DataFrame, keys: list[str], text: str, redact: bool) -> DataFrame:
    spark = df.sparkSession
    rows = df.select(text, *keys)
    model = spark.sparkContext.broadcast((trained(), common_words(rows, text)))  # fixed width; bounded by 1 / COMMON
    kinds = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)
    made: dict[int, Finder] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = made.get(0) or made.setdefault(0, Finder(*model.value))
        for big in batches:
            for b in (big.slice(k, 2000) for k in range(0, big.num_rows, 2000)):
                texts = b.column(0).to_pylist()
                spans = finder.spans(texts)
                if redact:
                    new = [_replace(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(new, pa.string())], names=[*keys, text])
                else:
                    hits = [(i, LABELS[k]) for i, s in enumerate(spans) for k in sorted({k for _, _, k in s})]
                    take = pa.array([i for i, _ in hits], pa.int64())
                    yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[1:]], pa.array([k for _, k in hits], pa.string())], names=[*keys, "pii_type"])

    return rows.mapInArrow(run, f"{kinds}, `{text}` string" if redact else f"{kinds}, pii_type string")


def _replace(text: str, spans: list[tuple[int, int, int]]) -> str:
    at = [m.span() for m in TOKEN.finditer(text)]
    out, last = [], 0
    for a, b, k in spans:
        out += [text[last : at[a][0]], f"[{LABELS[k].upper()}]"]
        last = at[b - 1][1]
    return "".join([*out, text[last:]])
