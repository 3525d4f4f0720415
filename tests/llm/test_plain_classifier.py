"""The classifier's features, descent and scores against plain loops."""

import math
import random

import numpy as np
import pyarrow as pa

from ephemera.llm import subword
from ephemera.llm.common import BASE, BYTE_VALUES, mixed, string_parts

MASK = 2**64 - 1


def bucket(data, salt):
    h = sum(int(BYTE_VALUES[b]) * pow(int(BASE), j, 2**64) for j, b in enumerate(data)) + salt & MASK
    return int(mixed(np.array([h], np.uint64))[0]) >> 47


def plain_features(text):
    words = (text or "").encode().translate(bytes(32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))).split(b" ")
    words = [w for w in words if w]
    out = [bucket(w, 1) for w in words] + [subword.REPEAT for a, b in zip(words, words[1:]) if a == b]
    for w in words:
        padded = b" " + w + b" "
        out += [bucket(padded[i : i + k], k << 8) for k in subword.GRAMS for i in range(len(padded) - k + 1)]
    return out


def plain_train(texts, labels, steps, seed=7):
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / subword.DIM, 1 / subword.DIM, (subword.BUCKETS, subword.DIM)).astype(np.float32).astype(float)
    out, bias = [[0.0] * subword.DIM, [0.0] * subword.DIM], [0.0, 0.0]
    features = [plain_features(t) for t in texts]
    order = np.concatenate([rng.permutation(len(labels)) for _ in range(-(-steps // len(labels)))])[:steps]
    for step, i in enumerate(order.tolist()):
        own = features[i]
        hidden = [sum(vectors[f][d] for f in own) / len(own) if own else 0.0 for d in range(subword.DIM)]
        z = [sum(o * h for o, h in zip(out[c], hidden)) + bias[c] for c in (0, 1)]
        e = [math.exp(x - max(z)) for x in z]
        p = [x / sum(e) - (c == labels[i]) for c, x in enumerate(e)]
        rate = subword.RATE * (1 - step / steps)
        push = [sum(rate * p[c] * out[c][d] for c in (0, 1)) for d in range(subword.DIM)]
        for c in (0, 1):
            out[c] = [o - rate * p[c] * h for o, h in zip(out[c], hidden)]
            bias[c] -= rate * p[c]
        for f in set(own):
            # a bucket moves by its share, measured against that of evenly spread features
            scale = min(own.count(f) / len(own) * len(set(own)), 1)
            vectors[f] = [v - scale * x for v, x in zip(vectors[f], push)]
    return vectors, out, bias


TEXTS = ["good plain words here", "bad BAD bad spam spam", "plain words and good lines\tof text", "spam é spam offer", "x", "", "good lines here here", "offer bad"]
LABELS = [1, 0, 1, 0, 1, 0, 1, 0]


def test_features_equal_plain_ones():
    rng = random.Random(2)
    texts = [*TEXTS, None, " \n ", *(" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 9))) for _ in range(50))]
    found, rows = subword.buckets(*string_parts(pa.array(texts, pa.string())))
    assert [sorted(found[rows == i].tolist()) for i in range(len(texts))] == [sorted(plain_features(t)) for t in texts]


def test_descent_and_scores_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(subword, "STEPS", 120)
    model = subword.train(TEXTS, LABELS)
    vectors, out, bias = plain_train(TEXTS, LABELS, 120)
    asked = [*TEXTS, "unseen words", None]
    got = subword.scores(model, *string_parts(pa.array(asked, pa.string())))
    want = []
    for t in asked:
        own = plain_features(t)
        hidden = [sum(vectors[f][d] for f in own) / len(own) if own else 0.0 for d in range(subword.DIM)]
        z = [sum(o * h for o, h in zip(out[c], hidden)) + bias[c] for c in (0, 1)]
        want.append(1 / (1 + math.exp(z[0] - z[1])))
    assert np.allclose(got, want, atol=2e-3) and max(got) - min(got) > 0.05
