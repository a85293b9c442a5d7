"""What the fitted models make of small samples, long texts and odd rows."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorestone.llm import common, language, toxicity, wordvec


def corpus(seed: int) -> list[tuple[int, str, int]]:
    rng = random.Random(seed)
    say = lambda n: " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(40)}" for _ in range(n))
    return [(i, say(60) + ("" if i % 4 else " wretch vermin"), int(i % 4 == 0)) for i in range(240)]


@pytest.mark.parametrize("seed", [21, 22, 23])
def test_toxicity_does_not_learn_small_samples_by_heart(seed):
    held = [r for r in corpus(seed) if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    learned = [r for r in corpus(seed) if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    net = toxicity.fit([r[1] for r in learned], [r[2] for r in learned])
    said = [net.score(toxicity.prepare(pa.array([t]), net.vocabulary))[0] >= toxicity.THRESHOLD for _, t, _ in held]
    right = sum(s and y for s, (*_, y) in zip(said, held, strict=True))
    assert right >= 0.95 * sum(y for *_, y in held) and right >= 0.95 * sum(said)


def plain_logit(net: toxicity.Network, words: list[str]) -> float:
    """One window, word by word."""
    p, h = net.p, toxicity.HIDDEN
    squash = lambda x: 1 / (1 + np.exp(-x))
    xs = []
    for w in words:
        raw = w.encode()
        key = wordvec.hashes(np.frombuffer(raw, np.uint8), wordvec.Words(np.array([0]), np.array([len(raw)]), np.array([0, 1])))[0]
        entry = int(np.flatnonzero(net.vocabulary == key)[0]) if key in net.vocabulary else len(net.vocabulary)
        marked = b"\x01" + raw + b"\x01"
        grams = [marked[i : i + toxicity.GRAM] for i in range(max(1, len(marked) - toxicity.GRAM + 1))]
        codes = []
        for g in grams:
            code = 0
            for b in g + b"\x01" * (toxicity.GRAM - len(g)):
                code = (code * 257 + b) % (1 << 64)
            codes.append(int(wordvec.mix64(np.array([code], np.uint64))[0] >> np.uint64(64 - 13)))
        xs.append(np.concatenate([p["word"][entry], np.mean([p["gram"][c] for c in codes], axis=0)]))
    states = {}
    for way in "fb":
        state, got = np.zeros(h), {}
        for t in range(len(xs)) if way == "f" else reversed(range(len(xs))):
            gates, u = xs[t] @ p[f"w{way}"] + p[f"c{way}"], state @ p[f"u{way}"]
            z, r = squash(gates[:h] + u[:h]), squash(gates[h : 2 * h] + u[h : 2 * h])
            state = (1 - z) * np.tanh(gates[2 * h :] + r * u[2 * h :]) * 1 + z * state
            got[t] = state
        states[way] = got
    both = [np.concatenate([states["f"][t], states["b"][t]]) for t in range(len(xs))]
    weight = np.exp([np.tanh(s @ p["a"]) @ p["v"] for s in both])
    return float(sum(w * s for w, s in zip(weight / weight.sum(), both, strict=True)) @ p["o"] + p["o0"][0]) if xs else float(p["o0"][0])


def test_toxicity_scores_are_those_of_a_plain_pass_over_every_window():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["al", "bee", "cedar", "d", "élan", "forest7"], n)) for n in (1, 5, 48, 49, 200)] + [""]
    first = toxicity.prepare(pa.array(texts), np.zeros(0, np.uint64))
    vocabulary = np.unique(first.hashed)[::2]
    net = toxicity.Network.new(vocabulary, rng.normal(size=len(vocabulary)).astype(np.float32))
    net.slope, net.shift = 1.5, 0.2
    got = net.score(toxicity.prepare(pa.array(texts), vocabulary))
    for text, score in zip(texts, got, strict=True):
        words = text.split()
        n = 1 + max(0, math.ceil((len(words) - toxicity.WINDOW) / toxicity.STRIDE))
        top = max(plain_logit(net, words[k * toxicity.STRIDE : k * toxicity.STRIDE + toxicity.WINDOW]) for k in range(n))
        assert score == pytest.approx(1 / (1 + math.exp(-(net.slope * top + net.shift))), abs=1e-4)


def test_language_messages_pass_whole_texts_and_their_lines():
    rng = np.random.default_rng(5)
    n, k = 5000, 3
    score, step = np.exp(rng.normal(size=(n, k))), np.exp(rng.normal(size=(k, k)) + 2 * np.eye(k))
    first = np.array([0, n - 7, n - 7, n])
    chance, _ = language.chain(score, step, first)
    for a, b in ((0, n - 7), (n - 7, n)):
        forward, back = [score[a] / score[a].sum()], [np.ones(k)]
        for t in range(a + 1, b):
            x = (forward[-1] @ step) * score[t]
            forward.append(x / x.sum())
        for t in range(b - 1, a, -1):
            x = step @ (score[t] * back[-1])
            back.append(x / x.sum())
        want = np.array(forward) * np.array(back[::-1])
        assert chance[a:b] == pytest.approx(want / want.sum(1, keepdims=True))
    f = language.prepare(pa.array(["one two\nthree", None, "four"]))
    assert f.first.tolist() == [0, 3, 3, 4]  # lines do not cut a chain


def test_language_document_scores_are_shares_of_letters():
    texts = ["thing house while", "schaft keit über", "thing thing schaft keit keit keit"]
    field = language.fit(texts[:2] * 30, ["en", "de"] * 30)
    best, share = field.predict(language.prepare(pa.array(texts)))
    for text, b, s in zip(texts, best, share, strict=True):
        words = language.label_words(text, field)
        f = language.prepare(pa.array([text]))
        chance = field.read(f, keep=True).chance
        letters = np.array([len(w.encode()) for w, *_ in words])
        want = (chance * letters[:, None]).sum(0) / letters.sum()
        assert b == want.argmax() and s == pytest.approx(want.max(), abs=1e-5)


def test_every_language_is_learned_and_too_many_are_an_error(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}word " * 5, f"l{i % 30}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.train(docs, folds=1000, held_out=999).languages) == 30
    monkeypatch.setattr(language, "MOST_LANGUAGES", 29)
    with pytest.raises(ValueError, match="more than 29 languages"):
        language.train(docs, folds=1000, held_out=999)


def test_the_sample_is_bounded_and_the_same_again(spark):
    rows = [(i, "x" * (5 + i % 7), i % 2) for i in range(50)] + [(100 + i, "y" * 40, 2) for i in range(9)] + [(3, "other", 1), (None, "no id", 1), (60, None, 1)]
    pool = spark.createDataFrame(rows, "doc_id long, text string, y int")
    def sample(pool):
        return common.fit_sample(pool.select("doc_id", "y", F.length("text").alias("size")), pool, 6, 20)[0]

    got, again = sample(pool), sample(pool.repartition(5))
    # of label 2 all texts are longer than 20: as many as fit 6 * 20 characters
    assert got == again and [sum(y == k for _, y in got) for k in (0, 1, 2)] == [6, 6, 3]
    assert all(len(t) <= 20 for t, y in got if y < 2)
    assert sample(pool.limit(0)) == []


def test_hashes_of_long_texts_go_by_pieces(monkeypatch):
    data = np.frombuffer(("word%d " * 400 % tuple(range(400))).encode(), np.uint8)
    words = wordvec.split(data, np.array([0, len(data)]))
    whole = wordvec.hashes(data, words)
    monkeypatch.setattr(wordvec, "SLICE_BYTES", 64)
    assert (wordvec.hashes(data, words) == whole).all() and len(set(whole.tolist())) == 400


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    rows = corpus(21)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    learned = sorted(r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1)
    want = toxicity.fit([r[1] for r in learned], [r[2] for r in learned], sum(r[2] for r in learned) / len(learned))

    def on_driver(*_):
        raise AssertionError("the driver fits the network")

    # tasks import the module anew; only this process has the patch
    monkeypatch.setattr(toxicity, "fit", on_driver)
    net = toxicity.train(docs, labels)
    assert (net.vocabulary == want.vocabulary).all() and (net.slope, net.shift) == pytest.approx((want.slope, want.shift), rel=1e-3)
