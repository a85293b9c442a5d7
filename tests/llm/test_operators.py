"""The training-data operators against brute force on small fixtures, with nulls, ties and repeats."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import tarfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lorestone.llm import decontaminate, language, lmscore, media, mixing, neardup, quality, secrets, sharding, toxicity, wordvec

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "Stone", "river", "étude", "gray", "lantern", "quiet", "seven", "harbour"]) + rng.choice(["", "", ",", ".", "s", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, prose(rng, rng.choice([1, 3, 20, 60, 200])), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for i in range(120)]
    base = out[5][1] + " " + prose(rng, 150)
    for k in range(12):  # near copies
        words = base.split(" ")
        for _ in range(k):
            words[rng.randrange(len(words))] = f"w{rng.randrange(99)}"
        out.append((200 + k, " ".join(words), "en", "a"))
    out += [(300, None, None, None), (301, "", "en", "a"), (302, " \t\n", "en", "b"), (303, "one", "en", "b"), (304, "One TWO", None, "c"), (None, "nameless text of no id", "en", "a"), (None, None, "en", "a")]
    out += [(310 + k, out[7][1], "en", "b") for k in range(5)] + [out[9], out[9]]
    out.append((400, prose(rng, 6000), "en", "a"))
    return [(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_hashes_match_plain_python(rows):
    texts = [r[1] for r in rows]
    data, offsets = wordvec.buffers(pa.array(texts, pa.string()))
    words = wordvec.split(data, offsets)
    hashed = wordvec.hashes(data, words)
    by_word = {}
    for i, text in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        plain = re.findall(WORD, text or "")
        assert [data[s:e].tobytes().decode() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)] == plain
        for w, h in zip(plain, hashed[a:b].tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_mixing_meets_targets(docs, rows):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(WORD, t or ""))
    total, per = sum(size(r[1]) for r in rows), defaultdict(int)
    for r in rows:
        per[r[3]] += size(r[1])
    order = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * total
    while open_:  # plain reading: share by weight, stop the full, share again
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * per[s]}
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: 2.0 * per[s] for s in full}
        left -= sum(2 * per[s] for s in full)
        open_ -= full
    source_of = {r[0]: r[3] for r in rows if r[0] is not None}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        if r.doc_id is not None:
            assert r.source_size == per[source_of[r.doc_id]]
            assert r.target == pytest.approx(target[source_of[r.doc_id]])


def test_mixing_emits_copies(docs):
    report, out = mixing.mix_report(docs), mixing.emit(docs)
    assert out.columns == docs.columns
    assert sum(len(re.findall(WORD, r.text or "")) for r in out.collect()) == report.selectExpr("sum(taken)").first()[0]
    assert sorted(map(str, mixing.emit(docs).collect())) == sorted(map(str, out.collect()))


def test_toxicity_learns(spark):
    rng = random.Random(5)
    bad = ["wretch", "vermin", "dunce", "grouch"]

    def text(y):
        words = prose(rng, rng.choice([30, 90, 200])).split(" ")
        for _ in range(rng.choice([1, 2, 4]) * y):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    rows = [(i, text(int(i % 4 == 0)), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, "!!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(77777, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    held = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= got[i].score <= 1 for i in (9000, 9001, 9002)) and got[9000].score == got[9001].score


def test_gradients_of_the_network():
    texts = ["a bad thing was here", "all good with the world", "bad bad day"]
    net = toxicity.fit(texts * 3, [1, 0, 1] * 3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    batch = toxicity.prepare(pa.array(texts), net.vocabulary)
    rows, y = np.arange(3), np.array([1.0, 0, 1])

    def loss():
        z = net.forward(batch, rows, net.inputs(batch))[0]
        return float((np.log1p(np.exp(z)) - y * z).sum())

    z, kept = net.forward(batch, rows, net.inputs(batch), keep=True)
    slopes = net.slopes(batch, kept, 1 / (1 + np.exp(-z)) - y)
    rng = np.random.default_rng(0)
    for name in ("uf", "wb", "cf", "a", "v", "o", "word", "gram"):
        flat = net.p[name].reshape(-1)
        used = np.flatnonzero(slopes[name].reshape(-1))
        for at in rng.choice(used, min(3, len(used)), replace=False):
            was = flat[at]
            flat[at] = was + 1e-5
            up = loss()
            flat[at] = was - 1e-5
            down = loss()
            flat[at] = was
            assert slopes[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=2e-5), name


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_secrets_match_plain_scan_and_ledger_is_incremental(spark, tmp_path):
    rng = random.Random(8)
    pieces = ['Token = "abcdef12"', "tokEn: x", "é password=hunter22, ", "AKIA" + "Z" * 16, "AKIAshort", "0123456789abcdef01234567", "deadbeef", "api_key:'Q/w+e=r-t_y.u'", "ſecret=longenough", "plain words", "ghp_" + "a1" * 18, "\n"]
    texts = [" ".join(rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(60)] + [None, "", "f" * 23, "f" * 24, "f" * 12]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, texts[0]), (900, texts[0])], "doc_id long, text string").repartition(3)
    ledger = str(tmp_path / "ledger")
    got = secrets.secrets_report(docs, ledger).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = base_spans((texts[0] if r.doc_id == 900 else texts[r.doc_id]) or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) or not want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
    scanned = secrets.read_ledger(spark, ledger).count()
    assert scanned == len({t or "" for t in texts})
    secrets.update_ledger(docs.union(spark.createDataFrame([(1000, "new token=abcdefgh")], "doc_id long, text string")), ledger)
    assert secrets.read_ledger(spark, ledger).count() == scanned + 1


def test_quality_learns_and_marginals_are_exact(spark):
    rng = np.random.default_rng(1)
    score, stay, first = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([0, 3, 5])
    good, _ = quality.marginals(score, first, stay)
    for a, b in itertools.pairwise(first):
        total, one = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=b - a):
            w = math.exp(sum(score[a + i] * s for i, s in enumerate(path)) + sum(stay[p, q] for p, q in itertools.pairwise(path)))
            total += w
            one += w * np.array(path)
        assert good[a:b] == pytest.approx(one / total)
    r = random.Random(2)
    rows = [(i, prose(r, 60) if i % 2 else "\n".join(["SALE!! " * 9, prose(r, 8) + " ###", "%% ** %%"] * 3), i % 2) for i in range(200)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(900, None), (901, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in quality.quality_report(docs, spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows]) > 0.97 and got[900].score == got[901].score


def test_sharding_is_even_and_whole(docs, rows):
    got = sharding.shard_report(docs, 8).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    size = Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max(r["size"] for r in got)
    assert max(size.values()) - min(size[k] for k in range(8)) <= 2.5 * most
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)


def test_shards_of_documents_keep_rows(docs, rows):
    got = sharding.shard_documents(docs, 5)
    assert got.columns == [*docs.columns, "shard", "slot"] and got.count() == len(rows)


def test_a_hot_text_is_split(spark):
    got = sharding.shard_report(spark.createDataFrame([(i, "same text") for i in range(900)], "doc_id long, text string"), 4).groupBy("shard").count().collect()
    assert len(got) == 4 and max(r["count"] for r in got) < 1.05 * min(r["count"] for r in got)


def test_language_marginals_and_prediction(spark):
    rng = np.random.default_rng(4)
    score, step, first = np.exp(rng.normal(size=(6, 3))), np.exp(rng.normal(size=(3, 3))), np.array([0, 4, 6])
    chance, _ = language.chain(score, step, first)
    for a, b in itertools.pairwise(first):
        want, total = np.zeros((b - a, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(b - a)):
            w = math.prod(score[a + i, s] for i, s in enumerate(path)) * math.prod(step[p, q] for p, q in itertools.pairwise(path))
            total += w
            for i, s in enumerate(path):
                want[i, s] += w
        assert chance[a:b] == pytest.approx(want / total)
    r = random.Random(1)
    stems = {"en": ["thing", "house", "while", "ough"], "de": ["schaft", "keit", "über", "ung"], "fr": ["eaux", "tion", "é", "ille"]}
    rows = [(i, " ".join("".join(r.choices(stems[g], k=2)) for _ in range(25)) + ".", g) for i in range(240) for g in [("en", "de", "fr")[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 !!", None), (902, "", "en"), (903, "…", "en")], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.language_report(docs).collect()}
    assert np.mean([got[i].lang_pred == g for i, _, g in rows]) > 0.97
    assert all(got[i].lang_pred == "und" for i in (900, 901, 902, 903))
    field = language.fit([t for _, t, _ in rows], [g for *_, g in rows])
    words = language.label_words("thinghouse whileough\nschaftkeit überung keitung", field)
    assert [g for _, g, _ in words] == ["en", "en", "de", "de", "de"]


def test_media_round_trip(docs, rows, tmp_path):
    folder = f"file://{tmp_path}/shards"
    got = media.media_report(docs, folder).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[(r[0], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_text = defaultdict(set)
    text_of = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            by_text[text_of[r.doc_id]].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    for shard in Path(tmp_path, "shards").iterdir():
        with tarfile.open(shard) as tar:
            for m in tar:
                assert m.name == hashlib.sha256(tar.extractfile(m).read()).hexdigest() + ".png"


ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_decontamination_matches_plain_search(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["a", "b", "c", "dd", "é", "x1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1 + 3 * (i > 3), 4, 9, 10, 14, 30]))) for i in range(4, 18)] + [(90, ""), (91, None), (92, "B! c? dd"), (92, "é é é é"), (None, say(12))]
    texts = [say(rng.choice([0, 3, 12, 40])) for _ in range(60)] + [f"{say(5)}-{items[k][1].upper()}; {say(4)}" for k in range(14)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(ITEM_WORD, low(t or ""))
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a : a + 10])].add(i)
    want = {}
    for d, t in enumerate(texts):
        w = re.findall(ITEM_WORD, low(t or ""))
        hit, found = set(), set()
        for window, ids in windows.items():
            for a in range(len(w) - len(window) + 1):
                if tuple(w[a : a + len(window)]) == window:
                    hit |= set(range(a, a + len(window)))
                    found |= ids
        ids = sorted(str(i) for i in found if i is not None)
        want[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    for block in (decontaminate.BLOCK_WORDS, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.scan_report(docs, benchmark).collect()}
        assert got == want
    cleaned = decontaminate.clean(docs, benchmark, most_coverage=1.0)
    assert decontaminate.scan_report(cleaned, benchmark).filter("contaminated").count() == 0
    assert cleaned.count() == len(texts)
    assert decontaminate.scan_report(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_language_model_matches_plain_counts_and_beats_chance(docs, rows):
    got = lmscore.lmscore_report(docs).collect()
    assert len(got) == len(rows)
    in_training = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    tokens = lambda t: [*re.findall(WORD, low(t or "")), None]
    counts = Counter(w for r in rows if in_training(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter((r[0], not in_training(r[0]), len(k), sum(w in counts for w in k), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in k), 6)) for r in rows for k in [tokens(r[1])])
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    long = [r for r in got if r.doc_id == 400][0]
    assert 0 < long.bits_per_byte < 3 if "bits_per_byte" in long else -long.score / math.log10(2) < 3 * len(rows[-1][1].encode())


def plain_components(rows, words, percent):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(WORD, low(t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


def test_near_duplicates_match_all_pairs(docs, rows):
    got = neardup.neardup_report(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_group_of_many_near_copies(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(700):  # around the threshold, so that many pairs are just not linked
        words = list(base)
        for at in rng.sample(range(80), rng.choice([0, 1, 2, 3, 4, 6, 8])):
            words[at] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = neardup.neardup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows, 3, 85)


def test_bands_miss_little():
    for setup in (neardup.Setup(), neardup.Setup(3, 85)):
        n, r = setup.bands
        assert (1 - (setup.percent / 100) ** r) ** n <= neardup.MISS and n * r <= neardup.MOST_COORDINATES


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(2)
    common, own = rng.integers(0, 2**63, 600, dtype=np.uint64), rng.integers(0, 2**63, (2, 200), dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, o])) for o in own]
    sign = neardup.signatures(np.concatenate(sets), np.array([0, 800, 1600]), 192)
    assert abs((sign[0] == sign[1]).mean() - 0.6) < 0.12


def test_empty_tables_and_clashing_names(spark, empty, docs, rows):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    runs = {
        "mix": lambda d: mixing.mix_report(d), "toxic": lambda d: toxicity.toxicity_report(d, none), "secret": lambda d: secrets.secrets_report(d), "quality": lambda d: quality.quality_report(d, none),
        "shard": lambda d: sharding.shard_report(d), "language": lambda d: language.language_report(d), "media": lambda d: media.media_report(d), "benchmark": lambda d: decontaminate.scan_report(d, items),
        "lm": lambda d: lmscore.lmscore_report(d), "near": lambda d: neardup.neardup_report(d),
    }
    clash = docs.limit(20)
    for name in ("size", "node", "held_out", "score", "shard", "uid", "cls", "key", "found", "word", "n", "row_key"):
        clash = clash.withColumn(name, docs["n_chars"])
    for name, run in runs.items():
        assert run(empty).count() == 0, name
        assert run(clash).count() == 20, name
