"""Sharding and the language model's mixer against plain loops."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorestone.llm import lmscore, sharding


def plain_tree(rows: list[dict], shards: int, slack: float) -> dict[int, list[int]]:
    """Recursive splits at weighted medians of sorted rows: the rows' numbers of each leaf."""
    wide = {d: max(r[d] for r in rows) - min(r[d] for r in rows) or 1e-12 for d in ("d0", "d1", "d2", "d3")}
    allowed = slack * sum(r["size"] for r in rows) / shards
    leaves: dict[int, list[int]] = {}

    def split(part: list[dict], name: int, k: int) -> None:
        if k == 1 or not part:
            leaves[name] = sorted(r["n"] for r in part)
            return
        spans = {d: (max(r[d] for r in part) - min(r[d] for r in part)) / wide[d] for d in wide}
        axis = max(spans, key=lambda d: spans[d])
        low, span = min(r[axis] for r in part), (max(r[axis] for r in part) - min(r[axis] for r in part)) or 1.0
        key = lambda r: (min(math.floor((r[axis] - low) / span * (1 << 20)), (1 << 20) - 1), (r["text_hash"] % (1 << 64)) >> 24)
        goal = sum(r["size"] for r in part) * (k // 2) / k
        groups = defaultdict(list)
        for r in part:
            groups[key(r)].append(r)
        below, left = 0, []
        for g in sorted(groups):
            at = sum(r["size"] for r in groups[g])
            if below + at <= goal and g != max(groups):
                below, left = below + at, left + groups[g]
                continue
            before, after = abs(goal - below), abs(below + at - goal)
            if min(before, after) > allowed:  # the group itself is split, by id
                ties = sorted(groups[g], key=lambda r: (r["id_hash"] % (1 << 64)) >> 4)
                sums = np.cumsum([r["size"] for r in ties])
                i = min(int(np.searchsorted(sums, goal - below, "right")), len(ties) - 1)
                take = i if goal - below - (sums[i] - ties[i]["size"]) <= sums[i] - (goal - below) else i + 1
                left = left + ties[:take]
            elif before > after:
                left = left + groups[g]
            break
        ids = {r["n"] for r in left}
        split(left, name, k // 2)
        split([r for r in part if r["n"] not in ids], name + k // 2, k - k // 2)

    split(rows, 0, shards)
    return {k: v for k, v in leaves.items() if v}


@pytest.mark.parametrize("shards", [8, 5])
def test_sharding_is_a_plain_k_d_tree(spark, shards):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "bé", "c", "delta\n"]) for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *[texts[0]] * 120, "", None, None])], "doc_id long, text string")
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"), F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id", F.lit("id")).alias("id_hash"),
        *[c.cast("double").alias(n) for n, c in sharding.text_metadata(F.col("text")).items()],
    )
    want = plain_tree([r.asDict() | {"n": r.doc_id} for r in rows.collect()], shards, 0.01)
    got, crc = defaultdict(list), {}
    for r in sharding.shard_report(docs, shards).collect():
        got[r.shard].append(r.doc_id)
        crc[r.doc_id] = r.text_crc32
    assert {k: sorted(v) for k, v in got.items()} == want
    assert crc == {r.doc_id: zlib.crc32((r.text or "").encode()) for r in docs.collect()}


def test_mixer_is_a_plain_loop_over_decisions():
    rng = random.Random(6)
    texts = [("".join(rng.choice("abc de") for _ in range(n))).encode() for n in (0, 1, 17, 70, 400, 130)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    code = lmscore.huffman(np.bincount(np.append(data, np.full(len(texts), lmscore.END)), minlength=lmscore.END + 1))
    pair, n = lmscore._counted(data, offsets, np.arange(len(texts)) > 1, code)
    known = lmscore.Known(pair[n > 0], n[n > 0])
    mixer = lmscore.Mixer(code)
    mixer.first = np.random.default_rng(2).normal(0.4, 0.1, mixer.first.shape).astype(np.float32)
    got = mixer.bits(lmscore.decisions(data, offsets, code, known), len(texts))
    for row in range(len(texts)):
        d = lmscore.decisions(data[offsets[row] : offsets[row + 1]], np.array([0, len(texts[row])]), code, known)
        weights, seen, total = mixer.first.astype(float).copy(), mixer.first_map.astype(float).copy(), 0.0
        for block in sorted(set(d.run_block.tolist())):
            nudges, moves = [], defaultdict(list)
            for run in np.flatnonzero(d.run_block == block):
                gate, a, b = d.run_gate[run], d.run[run], d.run[run + 1]
                slope = np.zeros(len(lmscore.ORDERS))
                for i in range(a, b):
                    inputs = np.array([s[i] for s in d.said], float)
                    x = min(max(float(weights[:, gate] @ inputs), -7.99), 7.99)
                    p = 1 / (1 + math.exp(-x))
                    place = round((x + 8) * lmscore.MAP_STEPS / 16)
                    final = 0.5 * p + 0.5 * seen[place]
                    chance = final if d.bit[i] else 1 - final
                    total -= math.log2(min(max(chance, 1 / 4096), 1 - 1 / 4096))
                    slope += (d.bit[i] - p) * inputs
                    moves[place].append(d.bit[i] - seen[place])
                nudges.append((gate, 0.1 * lmscore.RATE / max(b - a, 8) * slope))
            for gate, step in nudges:
                weights[:, gate] += step
            for place, errors in moves.items():
                seen[place] += np.mean(errors) * (1 - (1 - lmscore.MAP_RATE / 4) ** min(len(errors), 40))
        assert got[row] == pytest.approx(total, rel=1e-3)


def test_plain_probabilities_of_decisions_sum_to_one():
    """Any byte or the end may follow: their coded probabilities add up to 1 for even weights."""
    code = lmscore.huffman(np.arange(lmscore.END + 1))
    assert sum(2.0 ** -int(n) for n in code.length) == pytest.approx(1)
