"""Document scores of the quality field against all labellings of a document's lines."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa

from lorestone.llm import quality
from lorestone.llm import wordvec as wv


def plainly(field, text):
    """Each labelling by its weight; a line's chance is that of all labellings where it is good; chances weigh by length."""
    lines = quality.lines_of(*wv.buffers(pa.array([text], pa.string())))
    scores = (lines.features @ field.weights).tolist()
    whole, good = 0.0, [0.0] * len(scores)
    for labels in itertools.product((0, 1), repeat=len(scores)):
        weight = math.exp(sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(field.stay[a, b] for a, b in itertools.pairwise(labels)))
        whole += weight
        good = [g + weight * y for g, y in zip(good, labels, strict=True)]
    mean = sum(g / whole * w for g, w in zip(good, lines.weight, strict=True)) / sum(lines.weight)
    mean = min(max(mean, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(field.slope * math.log(mean / (1 - mean)) + field.shift)))


def test_document_scores(spark):
    rng = np.random.default_rng(5)
    pieces = ["The quiet river ran past the old mill.", "CLICK HERE!!! $$$", "a", "1 2 3 4 5", "", "Buy buy buy now now", "Étude of the gray stone, and of the harbour."]
    texts = ["\n".join(rng.choice(pieces, rng.integers(1, 9))) for _ in range(60)] + ["", None, "one line", "\n\n\n"]
    width = quality.lines_of(*wv.buffers(pa.array(["x"]))).features.shape[1]
    field = quality.Field(rng.normal(0, 0.7, width), rng.normal(0, 1, (2, 2)), 1.3, -0.2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts, pa.string())], ["doc_id", "held_out", "text"])
    (out,) = quality._score(iter([batch]), spark.sparkContext.broadcast(field))
    assert np.allclose(out.column("score").to_numpy(), [plainly(field, t or "") for t in texts], rtol=0, atol=1e-9)
