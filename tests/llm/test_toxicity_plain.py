"""Toxicity's features, trees and scores against plain loops."""

import math
import random
import re

import numpy as np

from lodestrata.llm import toxicity as M

LETTERS = re.compile(r"[^\W\d_]+")


def plain_features(lexicon, text):
    text = text or ""
    words, raw = LETTERS.findall(text.lower()), LETTERS.findall(text)
    n, chars = max(1, len(words)), max(1, len(text))
    tier = [lexicon.get(w, 0) for w in words]
    bad, second = [i for i, t in enumerate(tier) if t > 0], [i for i, w in enumerate(words) if w in M.SECOND]
    near = 0
    for i in bad:
        if second:
            near += min(abs(i - j) for j in second) <= M.NEAR
        else:
            near += n <= M.NEAR
    hidden = M.HIDDEN.findall(text)
    upper = sum(c.isupper() for c in text)
    if text.islower():
        upper = 0
    shout = sum(len(w) > 2 and w.isupper() for w in raw) if upper > 0.05 * chars else 0
    return [
        tier.count(1) / n, tier.count(2) / n, tier.count(3) / n, sum(t < 0 for t in tier) / n, len(bad), tier.count(3), len({words[i] for i in bad}), len(bad) / n,
        near, near / len(bad) if bad else 0.0, (len(second) if bad else 0) / n, upper / chars, shout / n, text.count("!") / chars, text.count("?") / chars,
        (chars - sum(len(w) for w in words) - text.count(" ")) / chars, len(hidden) / n, sum(lexicon.get(M.plain(w), 0) > 0 for w in hidden), len(M.STRETCHED.findall(text)) / n,
        math.log1p(len(words)), math.log1p(len(text) or 1),
    ]


def plain_trees(x, y):
    """Every cut of every feature at every node, one by one: the best second-order gain, the first of equals."""
    n = len(x)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, M.BINS + 1)[1:-1])) for j in range(x.shape[1])]
    p = min(1 - 1e-3, max(1e-3, y.mean()))
    base = math.log(p / (1 - p))
    f, trees = [base] * n, []
    for _ in range(M.TREES):
        prob = [1 / (1 + math.exp(-v)) for v in f]
        g, h = [y[i] - prob[i] for i in range(n)], [q * (1 - q) for q in prob]
        cuts, rows, leaves = {}, {0: list(range(n))}, {}
        for node in range(2**M.LEVELS - 1):
            own = rows.get(node, [])
            gt, ht = sum(g[i] for i in own), sum(h[i] for i in own)
            best = (1e-9, 0, math.inf)
            for j, e in enumerate(edges):
                for c in e:
                    left = [i for i in own if x[i, j] <= c]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    if hl < M.LEAF or ht - hl < M.LEAF:
                        continue
                    v = gl**2 / (hl + M.L2) + (gt - gl) ** 2 / (ht - hl + M.L2) - gt**2 / (ht + M.L2)
                    if v > best[0] + 1e-9:
                        best = (v, j, c)
            cuts[node] = best[1:]
            rows[2 * node + 1], rows[2 * node + 2] = [i for i in own if x[i, best[1]] <= best[2]], [i for i in own if x[i, best[1]] > best[2]]
        for node in range(2**M.LEVELS - 1, 2 ** (M.LEVELS + 1) - 1):
            own = rows[node]
            leaves[node] = M.RATE * sum(g[i] for i in own) / (sum(h[i] for i in own) + M.L2)
            for i in own:
                f[i] += leaves[node]
        trees.append((cuts, leaves))
    return base, trees


def plain_margin(base, trees, row):
    out = base
    for cuts, leaves in trees:
        node = 0
        while node in cuts:
            j, c = cuts[node]
            node = 2 * node + (1 if row[j] <= c else 2)
        out += leaves[node]
    return out


def test_features_are_the_plain_ones():
    rng = random.Random(3)
    lexicon = {"scum": 3, "rot": 2, "dull": 1, "kind": -1, "i": 1}
    parts = ["You", "scum", "ROT", "dull", "kind", "sc0m", "r0t", "s.c.u.m", "sooooo", "WHY!!", "?", "du", "hello", "Wörter", "x1y", "SCUM!", "i"]
    texts = ["", None, " ", "SCUM", "YOU SCUM", "123 !?", *(" ".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(300))]
    model = M.Model(lexicon)
    for t in texts:
        assert np.allclose(model.features(t), plain_features(lexicon, t)), t


def test_trees_are_the_plain_ones(monkeypatch):
    monkeypatch.setattr(M, "TREES", 6)
    monkeypatch.setattr(M, "BINS", 8)
    monkeypatch.setattr(M, "LEAF", 1.0)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 1, (90, 4)), 2)
    x[:, 3] = 0  # a feature that parts nothing
    y = (x[:, 0] * x[:, 1] + rng.normal(0, 0.3, 90) > 0).astype(int)
    model = M.Model({})
    M.boost(model, x, y)
    base, trees = plain_trees(x, y)
    new = np.round(rng.normal(0, 1, (200, 4)), 2)
    assert math.isclose(model.base, base)
    assert np.allclose(model.margin(new), [plain_margin(base, trees, r) for r in new])
    assert np.corrcoef(model.margin(x), y)[0, 1] > 0.5


def test_lexicon_by_plain_counts():
    rng = random.Random(6)
    clean, bad = [f"c{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)], ["awful", "vile"]
    texts = [" ".join(rng.choices([*clean, *(bad * 4 if i % 3 == 0 else [])], k=40)) for i in range(120)]
    labels = np.array([int(i % 3 == 0) for i in range(120)])
    texts += texts[:3] * 50  # copies count once
    labels = np.r_[labels, np.tile(labels[:3], 50)]
    found = M.lexicon(texts, labels)
    seen = [{(a, b, c) for t, y in zip(texts, labels, strict=True) if y == k for w in [["", *t.split(), ""]] for a, b, c in zip(w, w[1:], w[2:], strict=False)} for k in (0, 1)]
    for w in {*clean, *bad}:
        b, a = (sum(t[1] == w for t in s) for s in seen)
        ratio = math.log((a + 0.5) / len(seen[1])) - math.log((b + 0.5) / len(seen[0]))
        z = ratio / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        want = sum(z >= t for t in M.TIERS) if a + b >= M.LEAST and ratio >= math.log(M.FACTOR) and z >= M.TIERS[0] else -1 if a + b >= M.LEAST and ratio <= -math.log(M.FACTOR) and z <= -M.TIERS[1] else None
        assert found.get(w) == want
    assert set(bad) <= {w for w, t in found.items() if t > 0}
