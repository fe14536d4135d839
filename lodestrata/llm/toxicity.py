"""Toxicity of texts: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, trimmed

#: Labelled rows in the training sample (about); parts of it for the lexicon, the trees and the calibration.
ROWS, PARTS = 10_000, (0.35, 0.45, 0.2)
#: Trees, levels of a tree, step, bins of a feature, L2 of a leaf, least weight of a leaf.
TREES, LEVELS, RATE, BINS, L2, LEAF = 80, 3, 0.1, 64, 5.0, 4.0
#: z-scores that put a word in a lexicon tier, least occurrences of such a word, least ratio of its rates in the two classes.
TIERS, LEAST, FACTOR = (3.5, 5.0, 8.0), 6, 4.0
#: Words between a lexicon word and a second person that count as near.
NEAR = 6
WORDS = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"[^\W\d_]+[0-9@$*!|+.-]+[^\W\d_]+|[^\W\d_]*[0-9@$]+[^\W\d_]+")
STRETCHED = re.compile(r"(\w)\1{2,}")
#: Second persons; signs that stand for letters.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "*": "", ".": "", "-": ""})


def plain(word: str) -> str:
    """The word behind an obfuscated one."""
    return STRETCHED.sub(r"\1", word.lower().translate(SIGNS))


def gaps(at: list[int], to: list[int]) -> np.ndarray:
    """Of each position the distance to the nearest of the sorted positions ``to``, which aren't empty."""
    at, to = np.array(at, np.int64), np.array(to, np.int64)
    after = np.searchsorted(to, at)
    return np.minimum(np.abs(at - to[np.maximum(after - 1, 0)]), np.abs(at - to[np.minimum(after, len(to) - 1)]))


@dataclass
class Model:
    """Lexicon tiers (word -> 1..3; negative: words of clean texts), trees, and the calibration's knots."""

    lexicon: dict[str, int]
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def features(self, text: str | None) -> list[float]:
        """The dense features of a text; all zero but for a length of none if it is null or empty."""
        text = text or ""
        words = WORDS.findall(text.lower())
        n, get = max(1, len(words)), self.lexicon.get
        tiers = [(i, t) for i, t in enumerate(map(get, words)) if t]
        bad = [i for i, t in tiers if t > 0]
        of = Counter(t for _, t in tiers)
        second = [i for i, w in enumerate(words) if w in SECOND] if bad else []
        gap = gaps(bad, second) if second else np.full(len(bad), n)
        hidden = HIDDEN.findall(text)
        opened = [get(plain(w), 0) for w in hidden]
        chars = max(1, len(text))
        upper = sum(map(str.isupper, text)) if not text.islower() else 0
        shout = sum(1 for w in WORDS.findall(text) if len(w) > 2 and w.isupper()) if upper > 0.05 * chars else 0
        return [
            of[1] / n, of[2] / n, of[3] / n, sum(v for k, v in of.items() if k < 0) / n, len(bad), of[3], len({words[i] for i in bad}), len(bad) / n,
            float((gap <= NEAR).sum()), float((gap <= NEAR).mean()) if len(bad) else 0.0, len(second) / n,
            upper / chars, shout / n, text.count("!") / chars, text.count("?") / chars, (chars - sum(map(len, words)) - text.count(" ")) / chars,
            len(hidden) / n, sum(t > 0 for t in opened), len(STRETCHED.findall(text)) / n, np.log1p(len(words)), np.log1p(chars),
        ]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(LEVELS):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return np.interp(self.margin(np.array([self.features(t) for t in texts], float)), *self.knots)


def lexicon(texts: list[str], labels: np.ndarray) -> dict[str, int]:
    """Words by the z-score of their rate's log-ratio between the classes: tiers 1 to 3 for label 1, -1 for label 0.

    A word counts once for each pair of neighbours that it stands between, so a text with a thousand copies, or near copies,
    counts as one. Only words that are FACTOR times as frequent in one class get in.
    """
    seen: tuple[set, set] = (set(), set())
    for t, y in zip(texts, labels, strict=True):
        w = ["", *WORDS.findall(t.lower()), ""]
        seen[int(y)].update(zip(w, w[1:], w[2:], strict=False))
    count = [Counter(w for _, w, _ in s) for s in seen]
    n0, n1 = (max(1, len(s)) for s in seen)
    out = {}
    for w in count[0].keys() | count[1].keys():
        a, b = count[1][w], count[0][w]
        if a + b >= LEAST:
            ratio = np.log((a + 0.5) / n1) - np.log((b + 0.5) / n0)
            z = ratio / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if ratio >= np.log(FACTOR) and z >= TIERS[0]:
                out[w] = sum(z >= t for t in TIERS)
            elif ratio <= -np.log(FACTOR) and z <= -TIERS[1]:
                out[w] = -1
    return out


def boost(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Logistic boosting of full trees of LEVELS levels over quantile bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(p / (1 - p)))
    f = np.full(n, model.base)
    inner = 2**LEVELS - 1
    for _ in range(TREES):
        prob = 1 / (1 + np.exp(-f))
        g, h = y - prob, prob * (1 - prob)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(LEVELS):
            first, wide = 2**level - 1, 2**level
            at = node - first
            gain, choice = np.zeros(wide), [(0, np.inf, BINS)] * wide
            for j in range(width):
                key = at * BINS + bins[:, j]
                gs = np.bincount(key, g, wide * BINS).reshape(wide, BINS).cumsum(1)
                hs = np.bincount(key, h, wide * BINS).reshape(wide, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                v = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                v[(hs < LEAF) | (ht - hs < LEAF)] = 0
                v[:, len(edges[j]) :] = 0
                best = v.argmax(1)
                for k in np.flatnonzero(v[np.arange(wide), best] > gain + 1e-9):
                    gain[k], choice[k] = v[k, best[k]], (j, edges[j][best[k]], best[k])
            split = np.array([c[2] for c in choice])
            feature[first : first + wide], cut[first : first + wide] = [c[0] for c in choice], [c[1] for c in choice]
            node = 2 * node + 1 + (bins[np.arange(n), feature[node]] > split[at])
        leaves = node - inner
        leaf = RATE * np.bincount(leaves, g, inner + 1) / (np.bincount(leaves, h, inner + 1) + L2)
        model.trees.append((feature, cut, leaf))
        f += leaf[leaves]


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing step fit (pool adjacent violators), each block at its mean margin, joined by lines."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order], y[order], strict=True):
        blocks.append([m, v, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2] + a[2]]
    xs, ps = np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.05) / (b[2] + 0.1) for b in blocks])
    far = max(10.0, np.abs(xs).max() + 1)
    return np.r_[-far, xs, far], np.clip(np.r_[0.0, np.maximum.accumulate(ps), 1.0], 0, 1)


def train(rows: list[tuple[str, int]], seed: int = 9) -> Model | None:
    """The model from (text, label) rows; None if they hold no or one label.

    Lexicon, trees and calibration see different rows: each label's texts are dealt to the three by PARTS, at least one to
    each. Only a label with fewer than three different texts, which can't be dealt, gives all of them to each part.
    """
    rows = sorted({(t or "", int(y)) for t, y in rows})  # copies count once
    if len({y for _, y in rows}) < 2:
        return None
    y, rng = np.array([r[1] for r in rows]), np.random.default_rng(seed)
    dealt: list[list[np.ndarray]] = [[], [], []]
    for label in np.unique(y):
        own = rng.permutation(np.flatnonzero(y == label))
        cuts = np.clip(np.round(np.cumsum(PARTS)[:2] * len(own)).astype(int), [1, 2], [max(1, len(own) - 2), max(2, len(own) - 1)])
        for k, some in enumerate(np.split(own, cuts) if len(own) >= 3 else [own] * 3):
            dealt[k].append(some)
    a, b, c = (np.sort(np.concatenate(d)) for d in dealt)
    model = Model(lexicon([rows[i][0] for i in a], y[a]))
    boost(model, np.array([model.features(rows[i][0]) for i in b], float), y[b])
    model.knots = isotonic(model.margin(np.array([model.features(rows[i][0]) for i in c], float)), y[c])
    return model


def sample(docs: DataFrame, labels: DataFrame, most: int = ROWS, label: str = "toxic") -> list[tuple[str, int]]:
    """About ``most`` (text, label) rows, chosen by a hash of the id. Repeated labels of an id count by their largest."""
    known = labels.dropna(subset=["doc_id", label])
    n = known.count()
    bound = int(min(1.0, most / max(1, n)) * 2**63) - 1
    few = known.where(F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit(2**63 - 1)) <= bound).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("y"))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("text", "y")  # about ``most`` ids
    return [(r.text, r.y) for r in rows.collect()]


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row, from its whole text.

    A null text is scored as the empty one; ids may be null or repeated; without a model (no labels, or one kind only) the
    score is 0; an empty table gives no rows; other columns are not looked at.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column(1).to_pylist()) if model else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return settled(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(trimmed(each), "doc_id long, score double")
