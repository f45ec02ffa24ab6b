"""Operators with one right answer: against SQL, a reference library or brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import compare
from tallyforge.llm import capping, frequency, history, mixing, names
from tallyforge.llm import queries as Q
from tallyforge.llm import tokens as K


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_as_sql(spark, duck, data, name):
    compare(spark, duck, data, Q.QUERIES[name], Q.ORACLE[name])


# --- 4: caps -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_positions_over_partition_borders(spark, partitions):
    r = random.Random(partitions)
    rows = [(r.choice(["hot"] * 5 + ["a", "b", "c", None]), r.choice([None, 1, 2, 3]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "who string, score int, id int")
    got = {x.id: x.position for x in capping.positions(df, F.col("who"), [F.col("score").desc_nulls_last(), F.col("id").asc()], partitions).collect()}
    by = defaultdict(list)
    for w, s, i in rows:
        if w:
            by[w].append((-(s if s is not None else -1), i))
    assert got == {i: k for v in by.values() for k, (_, i) in enumerate(sorted(v), 1)}


def test_share_and_columns(spark):
    df = spark.createDataFrame([("a", i, "p") for i in range(8)] + [("b", 9, "p"), ("b", 10, "p")], "who string, id int, position string")
    over = capping.over_cap(df, F.col("who"), [F.col("id").asc()], share=0.5)
    assert sorted(x.id for x in over.collect()) == [5, 6, 7] and over.columns == ["who", "id", "position"]


# --- 5: frequencies ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("per_route", [5, 100_000])
def test_ngrams_like_brute_force(spark, per_route):
    r = random.Random(2)
    rows = [(" ".join(r.choice("abab c".split() + ["hot"] * 3) for _ in range(r.randint(1, 5))), [f"p{r.randrange(9)}" for _ in range(r.randint(0, 3))]) for _ in range(80)] + [(None, ["p1"])]
    df = spark.createDataFrame(rows, "term string, ids array<string>")
    got = {x.ngram: (x.occurrences, x.n_rows, x.n_records, x.term_rows, x.term_records) for x in frequency.ngram_counts(df, "term", "ids", sigma=3, per_route=per_route).collect()}
    occ, nr, np_, tr, tp = Counter(), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for k, (t, ids) in enumerate(rows):
        if t is None:
            continue
        w = t.split()
        tr[t].add(k)
        tp[t] |= set(ids)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if j - i <= 3 or i == 0:
                    g = " ".join(w[i:j])
                    occ[g] += 1
                    nr[g].add(k)
                    np_[g] |= set(ids)
    assert got == {g: (occ[g], len(nr[g]), len(np_[g]), len(tr[g]), len(tp[g])) for g in occ}


def test_long_ngrams_count_wherever_they_are(spark, folder):
    r = random.Random(3)
    terms = [" ".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(40)]
    rows = [{"candidate_id": i, "normalized_term": t, "source_post_ids": [f"t3_p{i % 7}"]} for i, t in enumerate(terms)]
    got = {x.ngram: (x.occurrences, x.n_rows, x.n_posts) for x in Q.p5_ngrams(spark, folder(keyword_candidates=rows)).collect()}
    occ, nr, np_ = Counter(), defaultdict(set), defaultdict(set)
    for k, t in enumerate(terms):
        w = t.split()
        for g in (" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)):
            occ[g] += 1
            nr[g].add(k)
            np_[g].add(k % 7)
    assert got == {g: (occ[g], len(nr[g]), len(np_[g])) for g in occ}


# --- 8: tokens ---------------------------------------------------------------------------------------------------------
def texts():
    r = random.Random(4)
    alphabet = list("ab cé1\n\t 漢🙂's<|endoftext|>ABC.,;-_") + ["  ", "ing", "don't", "́", "\r\n"]
    return ["", " ", "\n\n x", "a" * 3000, "hahaha" * 300, "<|endoftext|>", "=" * 999, "1234567890" * 50] + ["".join(r.choice(alphabet) for _ in range(r.randrange(120))) for _ in range(300)]


def test_same_ids_as_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{K.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    e = K.Encoder.load()
    for x in texts():
        assert e.encode(x) == t.encode(x, add_special_tokens=False).ids


def test_every_token_and_round_trip():
    e = K.Encoder.load()
    for i, b in list(e.bytes.items())[::37]:
        assert e.merged(b) == [i]
    for x in texts():
        assert b"".join(e.bytes[i] for i in e.encode(x)).decode() == x


# --- 9: mixture --------------------------------------------------------------------------------------------------------
def test_mixture_reaches_shares_within_repeats(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a"] * 30 + ["b"] * 10 + ["c"]), r.randint(1, 60)) for i in range(6000)] + [(9001, "a", 0), (9002, None, 5), (9003, "d", 50)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.3, 2), ("c", 0.2, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(sizes, targets).collect()
    n, tokens = Counter(), Counter()
    for x in mixed:
        n[x.doc_id] += 1
        tokens[x.source] += x.tokens
        assert 1 <= x.repeat_no <= {"a": 2, "b": 2, "c": 4}[x.source]
    assert len({(x.doc_id, x.repeat_no) for x in mixed}) == len(mixed) and 9001 not in n and 9003 not in n
    total = sum(tokens.values())
    for s, w in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert abs(tokens[s] / total - w) < 0.015
    size_c = sum(t for _, s, t in rows if s == "c")
    assert tokens["c"] > 3.5 * size_c  # the smallest source is used as often as it may be
    assert sorted(x.slot for x in mixed)[0] >= 0


def test_schedule_keeps_shares_in_every_stretch(spark):
    rows = mixing.schedule(spark, 2000, {"a": 0.5, "b": 0.3, "c": 0.2}).orderBy("slot").collect()
    for k in range(0, 2000, 200):
        c = Counter(x.source for x in rows[k : k + 200])
        assert abs(c["a"] - 100) <= 4 and abs(c["b"] - 60) <= 4
    ranks = defaultdict(list)
    for x in rows:
        ranks[x.source].append(x["rank"])
    assert all(v == list(range(len(v))) for v in ranks.values())


# --- 1: history --------------------------------------------------------------------------------------------------------
def sequential(posts, batch, common):
    """One row after the other; titles are compared word by word with all before."""
    speller = history.Speller(common)

    def pid(x):
        x = (x or "").strip().lower()
        return None if not x else x if x.startswith("t3_") else "t3_" + x

    def alike(f, g):
        return f[0] == g[0] or g[0] in f[1] or f[0] in g[1] or history.same(f[3], g[3], common)

    ids, old, said, out = set(), [], [], {}
    for p, t in sorted(posts):
        ids.add(pid(p))
        f = history.fingerprint(t, speller)
        if f:
            old.append((pid(p), f))
    for b, r, p, t in sorted(batch):
        q, f = pid(p), history.fingerprint(t, speller)
        if q and q in ids:
            out[r] = q
            continue
        if f:  # the history's full copies first, then its misspelt ones, then the batches' rows in their order
            hit = [i for i, g in old if f[0] == g[0]] or [i for i, g in old if alike(f, g)] or [i for i, g in said if alike(f, g)]
            if hit:
                out[r] = hit[0]
                continue
            said.append((q, f))
        if q:
            ids.add(q)
    return out


PARTS1, ENDS1 = ["oil pan", "turbo hose", "lift pump", "axle shaft"], ["leaks when cold", "rattles at idle", "went silent today"]


def history_tables(seed, n=200):
    r = random.Random(seed)
    title = lambda: f"{r.choice([2001, 2002, 2003])} Truck {r.choice(PARTS1)} {r.choice(ENDS1)}, {r.choice(['order ' + str(r.randrange(3000, 3020)), 'aka Tino-vusu', 'aka Tina-vusu', 'no number'])}, is it safe to drive"
    base = [title() for _ in range(60)]

    def bend(t):
        t = r.choice([t, t.upper(), "[Solved] " + t, ", ".join(reversed(t.split(", "))), t.replace(", ", "  "), t.replace("safe", "sfae"), t + " please help", t.replace("-", " "), t.replace("order ", "order #")])
        return t.replace("silent", "slient").replace("hose", "hsoe") if r.random() < 0.3 else t

    posts = [(f"t3_h{i}", t) for i, t in enumerate(base[:30])]
    batch = []
    for i in range(n):
        p = r.choice([f"t3_n{i}", f" T3_N{i} ", f"n{r.randrange(n)}", None, f"t3_h{r.randrange(40)}", ""])
        batch.append((i % 4 + 1, 1000 * (i % 4 + 1) + i, p, r.choice([None, bend(r.choice(base)), bend(r.choice(base)), bend(title())])))
    return posts, batch


def test_history_like_one_after_the_other(spark, folder, monkeypatch):
    posts, batch = history_tables(6)
    d = folder(posts=[{"post_id": p, "title": t} for p, t in posts], post_batches=[{"batch_no": b, "row_id": x, "post_id": p, "title": t} for b, x, p, t in batch])
    common = history.common_words(spark.createDataFrame([(t,) for _, t in posts], "title string"), "title")
    got = {x.row_id: x.post_id for x in Q.p1_found(spark, d).collect()}
    want = sequential(posts, batch, common)
    assert set(got) == set(want)
    assert {k: (got[k], want[k], [x for x in batch if x[1] == k]) for k in want if got[k] != want[k]} == {}
    # A second call opens the store of the first, and a small HOT refines the paragraphs' keys.
    monkeypatch.setattr(history, "HOT", 2)
    assert {x.row_id: x.post_id for x in Q.p1_found(spark, d).collect()} == got
    assert Q.p1_batches(spark, d).agg(F.sum("n_repeats")).first()[0] == len(want)


def test_batches_one_by_one_in_sessions_of_their_own(spark, tmp_path):
    """A store that is opened again for each batch gives what one pass over all of them gives, and reads no titles but the batch's."""
    posts, batch = history_tables(9, 60)
    common = history.common_words(spark.createDataFrame([(t,) for _, t in posts], "title string"), "title")
    path = f"file://{tmp_path}/store"

    def prints(store, rows, schema="b int, r long, p string, title string"):
        from tallyforge.session import written

        return written(store.prints(spark.createDataFrame(rows, schema), F.col("b"), F.col("r"), names.post_id(F.col("p")), "title"), "rows")

    store = history.Store.open(spark, path)
    store.append(prints(store, [(0, 0, p, t) for p, t in posts]))
    store.close()
    got = {}
    for k in (1, 2, 3, 4):
        store = history.Store.open(spark, path)
        checked = store.check(prints(store, [x for x in batch if x[0] == k]))
        got |= {x.r: x.match for x in checked.filter("repeats").collect()}
        store.append(checked.filter("NOT repeats"))
        store.close()
    assert got == sequential(posts, batch, common)


def test_same_and_other_titles():
    common = frozenset("question about fan clutch oil pan pump which rattles silent went order truck drive safe boot bolt".split())
    speller = history.Speller(common)
    finger = lambda t: history.fingerprint(t, speller)
    a = finger("Question about a fan clutch which rattles, Truck 2001, order 12,345")
    for t in ("x-post: truck 2001 | ORDER 12345 | qeustion about the fan clutch which rattles please help", "question about fan clutch which rattles truck 2001 order 12,345"):
        assert finger(t)[0] == a[0], t
    for other in ("Question about a oil pan which rattles, Truck 2001, order 12,345", "Question about a fan clutch which rattles, Truck 2002, order 12,345", "Question about a fan clutch which rattles, Truck 2001, order 12,346", "Question about a fan clutch which rattles, Truck 2001, Kesa-bifa"):
        b = finger(other)
        assert b[0] != a[0] and a[0] not in b[1] and not history.same(a[3], b[3], common)
    name = finger("Truck Tino-vusu went silent")
    assert finger("truck tino vusu went slient")[0] == name[0] and finger("Truck Tina-vusu went silent")[0] != name[0] and not history.same(name[3], finger("Truck Tina-vusu went silent")[3], common)
    unsure = finger("the bot rattles"), finger("the boot rattles")  # three letters are too few
    assert unsure[0][0] != unsure[1][0]
    feul = finger("oil pan pumb")
    assert finger("oil pan pump")[0] in feul[1] and feul[4]


def test_near_words_share_a_variant():
    r = random.Random(3)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(4, 11)))
        b = list(a)
        for _ in range(r.randint(1, 2)):
            k = r.randrange(len(b))
            b[k : k + 1] = r.choice([[], [r.choice("abc")], [b[k], r.choice("abc")]])
            if r.random() < 0.2 and k + 1 < len(b):
                b[k], b[k + 1] = b[k + 1], b[k]
        b = "".join(b)
        if len(b) >= 4 and history.near(a, b):
            assert history._variants(a) & history._variants(b), (a, b)
