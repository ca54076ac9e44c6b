import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wachter.llm import katz


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


def good_turing(n):
    """Discounts of counts 1 to 5 from n[r], the number of grams that occur r times: Katz's formula, or (r - g) / r if it fails."""
    d = {}
    for r in range(1, 6):
        try:
            cut = 6 * n[6] / n[1]
            d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
        except ZeroDivisionError:
            d[r] = 0
    if not all(0 < x < 1 for x in d.values()):
        g = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = {r: (r - g) / r for r in d}
    return d


def brute(docs, order):
    """A plain Katz model with dictionaries: (P(word | history) function, vocabulary, base function)."""
    train = [words(t) for d, t in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    grams = [None, *(Counter() for _ in range(order))]
    for w in train:
        padded = ["<s>"] * (order - 1) + w
        for i in range(order - 1, len(padded)):
            for k in range(1, order + 1):
                # contexts that reach before the text are cut to one start mark
                g = [x for x in padded[i - k + 1 : i + 1]]
                while len(g) > 2 and g[0] == g[1] == "<s>":
                    g = g[1:]
                grams[k][k, tuple(g)] += 1
    d = []
    for k in range(1, order + 1):
        d.append(good_turing(Counter(grams[k].values())))
    by = [{} for _ in range(order + 1)]
    for k in range(1, order + 1):
        for (_, g), c in grams[k].items():
            by[k].setdefault(g[:-1], {})[g[-1]] = c
    vocab = set(by[1].get((), {}))

    def cut(h):
        h = list(h)
        while len(h) > 1 and h[0] == h[1] == "<s>":
            h = h[1:]
        return tuple(h)

    def p(w, h, k):
        if k == 0:
            return 1.0 if w not in vocab else 0.0
        follow = by[k].get(cut(h[len(h) - k + 1 :]), {})
        total = sum(follow.values())
        if not total:
            return p(w, h, k - 1)
        dc = lambda c: c * (d[k - 1][c] if c <= 5 else 1)
        mass = sum(dc(c) for c in follow.values())
        base = total
        if mass >= total * (1 - 1e-12):
            mass, base = total, total + 1
            dc = lambda c: c
        if w in follow:
            return dc(follow[w]) / base
        return (1 - mass / base) / (1 - sum(p(x, h, k - 1) for x in follow)) * p(w, h, k - 1)

    n = sum(len(w) for w in train)
    return p, vocab, by[1].get((), {}), n


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_plain_model_and_sum_to_one(spark, order):
    rng = random.Random(3)
    vocab = ["a", "B", "c", "dd", "Ee", "f", "g", "hh"]
    docs = [(i, " ".join(rng.choice(vocab[: 2 + i % 7]) + ("x" if rng.random() < 0.05 else "") for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(100, None), (101, ""), (102, "\t\n "), (103, "unheard of " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "held", "block", "part")})
    scores, model = katz.score(df, F.expr("coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 1, false)"), order)
    got = {r["id"]: r for r in scores.collect()}
    p, known, count, n = brute(docs, order)
    assert len(got) == len(docs)
    for d, t in docs:
        w, r = words(t), got[d]
        h = ["<s>"] * (order - 1) + w
        want = sum(math.log10(p(x, tuple(h[i : i + order - 1]), order)) for i, x in enumerate(w))
        assert r["score"] == pytest.approx(want, rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (len(known) + 1))) for x in w), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in known for x in w), n)
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 1)
    for h in [("<s>", "<s>"), ("<s>", "a"), ("a", "b"), ("nowhere", "c")]:
        assert sum(p(x, h[3 - order :] if order > 1 else (), order) for x in [*known, "unseen-word"]) == pytest.approx(1)
    # the engine's own probabilities, from the stored model, of texts that it has not seen: after each beginning those of all words sum to 1
    after = ["", "a", "a b", "dd ee", "nowhere", "nowhere c", "f a nowhere"]
    every = sorted(known - {"</s>"}) + ["unseen-word"]
    new = [(f"{i}:{w}", f"{h} {w}") for i, h in enumerate(after) for w in every] + [(f"{i}", h) for i, h in enumerate(after)]
    fresh = spark.createDataFrame(new, "name string, body string")
    alone = {r["id"]: r["score"] for r in katz.score_new(fresh, model, "body", "name").collect()}
    for name, text in new:
        w = words(text)
        h = ["<s>"] * (order - 1) + w
        assert alone[name] == pytest.approx(sum(math.log10(p(x, tuple(h[i : i + order - 1]), order)) for i, x in enumerate(w)), rel=1e-9)
    one = [(f"{i}:{w}", f"{h} {w}") for i, h in enumerate(after) for w in every]
    ends = {name: math.log10(p("</s>", tuple((["<s>"] * 2 + words(text)[:-1])[-(order - 1) :]) if order > 1 else (), order)) for name, text in one + [(f"{i}", h) for i, h in enumerate(after)]}
    for i in range(len(after)):
        begin = alone[f"{i}"] - ends[f"{i}"]
        mass = sum(10 ** (alone[f"{i}:{w}"] - ends[f"{i}:{w}"] - begin) for w in every) + 10 ** ends[f"{i}"]
        assert mass == pytest.approx(1)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, held_out string")
    assert katz.digest(empty).count() == 0
    # ids that are all held out: nothing is learned; a null id; rows that repeat; a column with a clashing name
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = katz.digest(spark.createDataFrame([(held[0], "a b", "x"), (held[1], None, "x")], "doc_id long, text string, score string")).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["score"] == 0 for r in rows)
    rows = katz.digest(spark.createDataFrame([(None, "a b", "x"), (None, "a b", "x")], "doc_id long, text string, _held string")).collect()
    assert [(r["held_out"], r["train_tokens"]) for r in rows] == [(False, 6)] * 2


def test_split_contexts(spark, monkeypatch):
    """Contexts that are split over partitions, and messages that travel in bundles, give the same scores."""
    docs = spark.createDataFrame([(i, "the " * (i % 5) + f"w{i % 9} the end") for i in range(80)], "doc_id long, text string")
    want = {r["doc_id"]: r["score"] for r in katz.digest(docs).collect()}
    plain = katz.Model.__init__

    def few(self, spark, parts, tokens):
        plain(self, spark, 7, tokens)
        self.limit = 2

    monkeypatch.setattr(katz.Model, "__init__", few)
    got = {r["doc_id"]: r["score"] for r in katz.digest(docs).collect()}
    assert got == pytest.approx(want)
    monkeypatch.setattr(katz, "DIRECT", 1)
    monkeypatch.setattr(katz, "BUNDLE_BYTES", 200)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 30)
    scores, model = katz.score(docs, F.lit(False), 3)
    more = {r["id"]: r["score"] for r in katz.score_new(docs, model).collect()}
    assert len(more) == 80 and more == pytest.approx({r["id"]: r["score"] for r in scores.collect()})
    assert {r["doc_id"]: r["score"] for r in katz.digest(docs.repartition(5)).collect()} == pytest.approx(want)


def test_messages():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        x = [rng.integers(0, top, n).astype(np.uint64) for top in (2, 300, 70_000, 2**40, 2**63)] + [rng.random(n), rng.random(n) < 0.5]
        for a, b in zip(x, katz._unpack(katz._pack(*x)), strict=True):
            assert (a == b).all()


def test_odd_ids_and_long_texts(spark):
    df = spark.createDataFrame([("x1", "a b a b"), (None, "a"), ("x1", "a b a b"), ("x2", "w " * 500_000)], "doc_id string, text string")
    got = katz.digest(df).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("None", 2), ("x1", 5), ("x1", 5), ("x2", 500_001)]
    assert all(r["score"] < 0 for r in got)
