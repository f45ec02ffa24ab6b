"""Learned operators: held-out accuracy, and what must hold whatever was learned."""

import math
import random
import re
import time
import zlib

import pytest

from tallyforge.llm import abuse, abuse_samples, pii, pii_samples, subjects, truncation
from tallyforge.llm import queries as Q

PARTS = "oil pan, turbo hose, lift pump, axle shaft, fan clutch, door latch, head gasket, tank sender".split(", ")
ENDS = "leaks when it is cold, rattles at idle, went silent after the trip, smells of burnt rubber, will not hold pressure".split(", ")


def sentence(r):
    return r.choice(["The {0} {1}.", "My mechanic said that the {0} {1}.", "If you care about the {0}, look at the {2} first.", "What finally helped was the {0}.", "Half of the cost was the {0}, the rest was the {2}."]).format(r.choice(PARTS), r.choice(ENDS), r.choice(PARTS))


# --- 2: cut texts ------------------------------------------------------------------------------------------------------
def test_cuts_are_found(spark, folder):
    r = random.Random(1)
    rows, cut = [], set()
    for i in range(1500):
        t = " ".join(sentence(r) for _ in range(r.randint(1, 4)))
        if i % 6 == 0:
            k = r.randint(15, len(t) - 12)
            t = t[:k].rstrip()
            if t[-1] in ".,!?" or t.endswith(tuple(PARTS)) or t.endswith(tuple(ENDS)):
                t = t.rstrip(".,!? ") + ", and the"
            cut.add(f"c{i}")
        elif i % 6 == 1:
            t = t[:-1] + r.choice(["", "...", " :)", " lol", "…"])
        rows.append({"comment_id": f"c{i}", "body": t, "source_surface": "s"})
    got = {x.comment_id for x in Q.p2_found(spark, folder(comments=rows)).collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.06 * len(rows)


def test_all_intact_texts_are_counted_and_trained_on(spark):
    """Not the first by a hash: every text, whatever the size of a group."""
    r = random.Random(4)
    rows = [(f"c{i}", f"{sentence(r)} It went to the shop of Mister {'abcdefgh'[i % 8] * 5}.", "s") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t string, s string").repartition(3)
    n, counts = truncation.counted(df, "t")
    alone = truncation._Counter().add(t for _, t, _ in rows).counts()
    assert n == 400 and (counts == alone).all()
    at = truncation.Endings(counts=counts.sum(axis=0)).features(["mister", "ccccc"])
    assert ("can2", 1.0) in at and abs(dict(at)["ends2"] - truncation.math.log(50.2 / 0.2)) < 1e-9
    got = [truncation.learned(df.repartition(p), "k", "t", "s", {}, counts, n, 64) for p in (2, 5)]
    assert [x[1] for x in got] == [400, 400] and abs(got[0][0] - got[1][0]).max() < 1e-9


def test_limits_are_found(spark):
    r = random.Random(2)
    rows = [("a", "x" * min(120, r.randint(50, 300))) for _ in range(900)] + [("b", "x" * r.randint(50, 300)) for _ in range(900)]
    assert truncation.limits(spark.createDataFrame(rows, "s string, t string"), "t", "s") == {"a": [120]}


def test_closers_take_no_exponential_time():
    for t in ("." * 5000 + "x", "!?" * 3000 + "y", "… " * 3000 + "z", ":)" * 2000 + "q"):
        truncation.features(t, "off", truncation.Endings([]))


def test_of_a_long_line_its_end_costs():
    """What comes before the last sentence takes less than one pass over it by an expression."""
    end, known = "It went to the (old shop of http://exa", truncation.Endings(["It went to the old shop."])
    t = "Half of the cost was the oil pan. " * 4000 + end

    def took(f):
        each = []
        for _ in range(3):
            begun = time.process_time()
            f()
            each.append(time.process_time() - begun)
        return min(each)

    assert truncation.features(t, "off", known) == truncation.features(end, "off", known)
    assert took(lambda: truncation.features(t, "off", known)) < took(lambda: truncation._SENTENCE.split(t))


def plain_features(text, at_limit, totals, finals):
    """Names and values of a text's features, one text and one feature at a time."""
    tail = text.rstrip().rsplit("\n", 1)[-1]
    closer = truncation._CLOSER.search(tail)
    mark = closer.group().strip() if closer else ""
    flat = truncation._SENTENCE.split(tail[: closer.start()] if closer else tail)[-1]
    w = ["#" if x.isdigit() else x.lower() for x in truncation._WORD.findall(flat)]
    while w and not w[-1][0].isalnum() and w[-1] != "#":
        w.pop()
    kind = "none" if not mark else "dots" if re.fullmatch(r"\.\.+|…", mark) else "bracket" if "[" in mark else "stop" if re.fullmatch(r"[.!?]+", mark) else "other"
    known, longest, ends = 0, None, []
    for n in range(1, min(len(w), 4) + 1):
        h = n
        for x in w[-n:]:
            h = (h * truncation._TIMES + zlib.crc32(x.encode("utf-8", "surrogatepass"))) & truncation._ALL
        at = (h * truncation._SPREAD & truncation._ALL) >> truncation._SHIFT
        if totals[at]:
            rate = (int(finals[at]) + 0.2) / (int(totals[at]) + 0.4)
            known, longest = n, (math.log(rate / (1 - rate)), finals[at])
            ends += [(f"ends{n}", longest[0]), (f"{'can' if longest[1] else 'never'}{n}", 1.0)]
    ends.append((f"known{known}/{min(len(w), 4)}", 1.0))
    ends += [("longest", longest[0]), (f"longest{known}{'' if longest[1] else 'never'}", 1.0)] if longest else []
    last = flat.rstrip()[-6:]
    named = [(f"kind={kind}", 1.0), (f"limit={at_limit}", 1.0), (f"kind={kind},limit={at_limit}", 1.0), ("one", 1.0), (f"short={min(len(w), 3)}", 1.0)]
    named += [(f"{kind}:{n}", v) for n, v in ends] + [(f"c{n}={kind}{last[-n:].lower()}", 0.5) for n in (1, 2, 3)]
    named += [(f"w={kind}{w[-1]}", 0.5), (f"w={w[-1]}", 0.5)] if w else []
    named += [(f"open{a}", 1.0) for a, b in ("()", "[]", "“”", "«»") if flat.count(a) > flat.count(b)]
    flags = {"openquote": flat.count("`") % 2 or flat.count('"') % 2, "code": re.search(r"&#?\w{0,7}$|%[0-9A-Fa-f]?$|\\u?[0-9a-fA-F]{0,3}$", flat), "broken": "�" in tail[-3:], "joint": flat[-1:] in set(",;:-–—/&'’")}
    links = [x for x in (r"(?:https?:|www\.)[^\s)]*$", r"\bhttps?$|\bwww$") if re.search(x, flat)]
    return named + [(k, 1.0) for k, v in flags.items() if v] + [("link", 1.0) for _ in links]


def test_features_in_batches():
    """The same places and values as one at a time, whatever the texts, for less than half the time on ordinary ones."""
    r = random.Random(8)
    bits = ["lol", " lol", "xD", "edit: ", "EDIT:", "re-edit: foo", " /s", "?", "!", "...", "…", "[...]", " ", "  ", "\t", "\xa0", "\n", ":)", ":-D", "<3", "^^", "👍", "☀", "❶", "ſ", "İ", "Σ", "²", "12", "#", "http", "https:", "www.", "(", ")", "[", "“", "«", '"', "`", "&am", "&#82", "%C", "\\u00e", "�", ",", "-", "’", "word", "don't", "a_b", "thx", ". ", "! ", "… ", ".\t", "日本", "\x1c", ":", "x", "D", "3", "maxD", "\ud83d"]
    odd = ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(6000)]
    common = [" ".join(sentence(r) for _ in range(r.randint(1, 4)))[: r.randint(20, 300)] for _ in range(6000)]
    counts = truncation._Counter().add(common[:3000] + odd[:1000]).counts()
    endings = [truncation.Endings(counts=c) for c in counts]
    halves, limit = [r.randint(0, 1) for _ in range(6000)], [r.choice(["off", "at", "before", "beyond"]) for _ in range(6000)]
    took = []
    for texts in (odd, common):
        begun = time.process_time()
        rows = truncation.encoded(texts, limit, endings, halves)
        middle = time.process_time()
        want = [[(truncation.bucket(n, truncation.WIDTH), v) for n, v in plain_features(t, a, *counts[h])] for t, a, h in zip(texts, limit, halves, strict=True)]
        took = [middle - begun, time.process_time() - middle]
        w = [math.sin(i) for i in range(truncation.WIDTH)]
        assert abs(rows.dot(truncation.np.array(w)) - [sum(w[p] * v for p, v in x) for x in want]).max() < 1e-9
        assert (rows.seen(truncation.WIDTH) == truncation.np.bincount([p for x in want for p, _ in x], minlength=truncation.WIDTH)).all()
        for i in range(0, 6000, 7):
            got = sorted(rows.row(i))
            assert [p for p, _ in got] == [p for p, _ in sorted(want[i])] and all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, sorted(want[i]), strict=True)), texts[i]
    assert took[0] < took[1] / 2


# --- 3: personal data --------------------------------------------------------------------------------------------------
def kinds_found(f, sents, skip=True):
    """Precision and recall of kinds in texts."""
    found = f.spans(["".join(t for t, _ in s) for s in sents], skip)
    right = wrong = missed = 0
    for parts, spans in zip(sents, found, strict=True):
        want = {pii.LABELS[pii._OF[k]] for _, k in parts if k}
        got = {pii.LABELS[k] for *_, k in spans}
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
    return right / (right + wrong), right / (right + missed)


KNOWN = frozenset(w.lower() for c in pii_samples.NONE + pii_samples.WEAK + [x for v in pii_samples.CARRIERS.values() for x in v] for w in pii.TOKEN.findall(c) if w.isalpha())


def test_held_out_sentences():
    precision, recall = kinds_found(pii.Finder(pii.trained(), KNOWN), pii_samples.sentences(seed=99, n=1200))
    assert precision > 0.94 and recall > 0.94


def test_held_out_phrases():
    """Trained without a quarter of the phrases, measured on those alone."""
    crf = pii.fitted(pii_samples.sentences(n=8000, part=(0, 4)), epochs=6)
    precision, recall = kinds_found(pii.Finder(crf, KNOWN), pii_samples.sentences(seed=5, n=1200, part=(0, 4), held=True))
    print("held-out phrases", precision, recall)
    assert precision > 0.85 and recall > 0.85


def test_placeholders_keep_the_rest():
    f = pii.Finder(pii.trained(), KNOWN | frozenset("call after six mail me at please the order".split()))
    t = "Call 212-555-0199 after six.\nMail ana.hart@post.example please. Batch 20250314-0093 had the bad seals."
    s = f.spans([t, None, "", " "])
    assert s[1:] == [[], [], []]
    new = pii._replace(t, s[0])
    assert "[PHONE]" in new and "[EMAIL]" in new and "555" not in new and "Batch 20250314-0093 had the bad seals." in new and "\n" in new


def test_edges_find_second_mentions():
    """Entities that are mentioned again where nothing around tells: without the edges clearly fewer are found."""
    f = pii.Finder(pii.trained(), KNOWN)
    sents = pii_samples.sentences(seed=7, n=800, repeats=1.0)
    texts = ["".join(t for t, _ in s) for s in sents]
    with_, _, at, doc, (_, second, _), unsettled = f.labels(texts)
    without = f.labels(texts, False)[0]
    gold = [[pii._OF[kind] for t, kind in s for _ in pii.TOKEN.findall(t)] for s in sents]
    want = [(j, gold[int(doc[j]) - 1][j - at[int(doc[j]) - 1]]) for j in second.tolist()]
    want = [(j, y) for j, y in want if y]
    hit = [sum(labels[j] == y for j, y in want) / len(want) for labels in (with_, without)]
    assert hit[0] > 0.93 and hit[1] < hit[0] - 0.05 and len(unsettled) <= 8


def test_a_label_reaches_every_mention(spark):
    """Through a chain of edges, however long."""
    import numpy as np

    n = 9
    crf = pii.trained()
    u = np.zeros((2 * n + 4, 6), np.float32)
    u[:, 0] = 20
    own = np.arange(2, 2 * n + 2, 2)
    u[own] = 0
    u[own, 5] = 2 * crf.trans[0, 0] - crf.trans[0, 5] - crf.trans[5, 0] - 0.3  # a little less than 'none'
    u[own[0], 5] += 30
    codes = np.array([0, 0, *[c for k in range(n) for c in (1, 2 + k)], 0, 0])
    doc = np.array([0, 0] + [1] * (2 * n + 2))
    edges = (own[:-1], own[1:], np.zeros(n - 1, int))
    with_, unsettled = pii.decode(crf, u, doc, codes, edges)
    assert (with_[own] == 5).all() and not len(unsettled)
    assert not (pii.decode(crf, u, doc, codes, (own[:0],) * 3)[0][own] == 5).all()


def test_edges_link_like_and_similar_words():
    import numpy as np

    words = ["hallow", "x", "hallow", "hallaw", "hallow"]
    keys = np.array([0, -1, 0, 0, 0])
    i, j, kind = pii.links(np.array([1, 1, 1, 1, 2]), keys, pii._numbers(words, {}))
    assert list(zip(i, j, kind, strict=True)) == [(0, 2, 0), (2, 3, 1)]
    assert pii.link_key("Abernane", False) == pii.link_key("abernan", False) and pii.link_key("2125550199", False) == pii.link_key("0199", False) and pii.link_key("pump", True) is None


def test_labels_do_not_depend_on_the_batch():
    f, g = pii.Finder(pii.trained(), KNOWN), pii.Finder(pii.trained(), KNOWN)
    texts = ["".join(t for t, _ in s) for s in pii_samples.sentences(seed=3, n=80)]
    assert f.spans(texts) == [g.spans([t])[0] for t in texts]


def test_cutting_chains_loses_nothing():
    """The labels are those of the best of all labellings."""
    import itertools

    import numpy as np

    crf, r, n = pii.trained(), np.random.default_rng(1), 5
    for _ in range(60):
        u = r.normal(0, 4, (n, 6)).astype(np.float32)
        score = lambda l: sum(u[i, l[i]] for i in range(n)) + crf.trans[0, l[0]] + crf.trans[l[-1], 0] + sum(crf.trans[l[i], l[i + 1]] for i in range(n - 1))  # noqa: B023, E731, E741
        best = max(itertools.product(range(6), repeat=n), key=score)
        whole = np.zeros((n + 4, 6), np.float32)
        whole[[0, 1, -1, -2], 0] = 99
        whole[2:-2] = u
        codes, doc = np.array([0, 0, *range(1, n + 1), 0, 0]), np.array([0, 0] + [1] * (n + 2))
        assert tuple(pii.decode(crf, whole, doc, codes, (np.zeros(0, int),) * 3)[0][2:-2]) == best


# --- 7: abuse ----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def net():
    return abuse.fitted([])


def test_abuse_held_out(net):
    score = abuse.Scorer(net)
    held = abuse_samples.sentences(seed=77, n=2000)
    got = score([t for t, *_ in held])
    for lang in abuse.LANGUAGE:
        p = [(g >= 0.5, y) for g, (_, la, y) in zip(got, held, strict=True) if la == lang]
        hit = sum(a and y for a, y in p)
        assert hit / sum(y for _, y in p) > 0.9, lang
        assert sum(a and not y for a, y in p) / max(1, sum(not y for _, y in p)) < 0.05, lang


def test_abuse_cases(net):
    score = abuse.Scorer(net)
    bad = ["You are a w.o.r.t.h.l.e.s.s 1d10t.", "shut your mouth, m o r o n", "Du bist ein Vollidiot.", "Ferme ta gueule, espèce de crétin", "you are a complete c****n"]
    good = ["I was an idiot and forgot the drain plug.", "Grease the nipple and screw it back in.", "This piece of crap pump quit again.", "Hit it with the bastard file until it sits flat.", None, "", "  ", "👍"]
    assert all(s >= 0.5 for s in score(bad)) and all(s < 0.5 for s in score(good))
    assert score(["Fine text. " * 50 + bad[0]])[0] >= 0.5  # the worst sentence counts


def test_score_does_not_depend_on_the_batch(net):
    a, b = abuse.Scorer(net), abuse.Scorer(net)
    texts = [t for t, *_ in abuse_samples.sentences(seed=3, n=60)]
    assert a(texts) == pytest.approx([b([t])[0] for t in texts], abs=1e-5)


# --- 10: subjects ------------------------------------------------------------------------------------------------------
NOUNS = {"law": ["the contract clause", "the court order", "the appeal", "the lease", "the witness"], "food": ["the pie crust", "the sourdough", "the bone broth", "the lemon zest", "the risotto"], "sport": ["the penalty kick", "the goal keeper", "the relay team", "the cup final", "the sprint"]}


def subject_tables(n=600, seed=8):
    r = random.Random(seed)
    say = lambda s: r.choice(["Nobody warned me about {0}.", "Most of the advice about {0} is old.", "What helped was {0}, not {1}.", "Does anyone know {0}?"]).format(*r.sample(NOUNS[s], 2))
    chat = lambda: r.choice(["I will report back.", "Thanks for reading.", "It might be nothing."])
    samples = [{"sample_id": i, "subject": s, "lang": "en", "text": " ".join(say(s) for _ in range(3))} for i, s in enumerate(list(NOUNS) * 8)]
    docs, want = [], set()
    for i in range(n):
        main = r.sample(list(NOUNS), r.choice([0, 1, 1, 1, 2]))
        parts = [say(s) for s in main for _ in range(r.randint(3, 5))] + [chat() for _ in range(r.randint(1, 3))]
        other = [s for s in NOUNS if s not in main]
        if main and r.random() < 0.3:
            parts.append(say(r.choice(other)))  # in passing
        r.shuffle(parts)
        docs.append({"doc_id": i, "text": " ".join(parts)})
        want |= {(i, s) for s in main}
    return samples, docs, want


def test_subjects_found(spark, folder):
    samples, docs, want = subject_tables()
    got = {(x.doc_id, x.subject) for x in Q.p10_found(spark, folder(documents=docs, subject_samples=samples)).collect()}
    assert len(got & want) / len(got) > 0.93 and len(got & want) / len(want) > 0.93


def test_redundant_rules_go():
    j = subjects.Judge([(("a",), "x", 2.0), (("b", "c"), "y", 3.0)])
    assert j.sentence("a c") == ("x", 2.0) and j.sentence("b c a") == ("y", 1.0) and j.sentence("zzz") is None
    assert j.document("a. a. b c.", 0.5) == [("x", 2)]


def test_long_sentences_keep_all_their_items(spark):
    words = {"law": "appeal bailiff clause docket evidence felony guardian hearing", "food": "broth crust dough glaze lemon risotto sorbet zest"}
    labelled = [(s, f"{w}. {w}. {w}.") for s, w in words.items()]
    docs = spark.createDataFrame([(f"{w}. {w}. {w}.",) for w in words.values() for _ in range(10)], "text string")
    rules = {k: s for k, s, _ in subjects.mine(docs, "text", labelled, [])}
    assert {k[0] for k in rules if len(k) == 1} == {x for w in words.values() for x in w.split()}


def test_rules_are_those_of_all_item_sets(spark):
    import itertools
    import math
    from collections import Counter

    r = random.Random(4)
    rows = [(s := r.choice("xyz"), sorted(r.sample("abcdefghi", r.choice([1, 2, 3, 8, 9])) + r.sample("pqr", s == "z")), r.randint(1, 3)) for _ in range(60)]
    rows += [(s, [*"jkl"], 9) if odd else (s, sorted(r.sample("jkl", 2)), 4) for s, odd in [("x", True), *[("y", False)] * 8, *[("z", False)] * 8]]
    count, prior = Counter(), Counter()
    for s, own, n in rows:
        prior[s] += n
        for k in (k for size in range(1, len(own) + 1) for k in itertools.combinations(own, size)):
            count[k, s] += n
    want, strength = {}, {}
    for k in sorted({k for k, _ in count}, key=len):
        share = {s: count[k, s] / prior[s] for s in "xyz"}
        s = max("xyz", key=share.get)
        n = count[k, s]
        if n >= 4:
            strength[k] = (s, c := (share[s] / sum(share.values()) * n + 0.5) / (n + 1.5))
            parts = [strength[p] for size in range(1, len(k)) for p in itertools.combinations(k, size) if p in strength]
            if c >= subjects.CONFIDENCE and not any(p[0] == s and p[1] >= c - 1e-3 for p in parts):
                want[k] = (s, round(math.log(c / (1 - c)), 9))
    got = {k: (s, round(w, 9)) for k, s, w in subjects.rules_of(spark.createDataFrame(rows, "subject string, items array<string>, n long"), 4)}
    assert got == want and max(map(len, got)) >= 3
