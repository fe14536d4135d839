"""Language of words and documents by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, trimmed

LETTERS = re.compile(r"[^\W\d_]+")
#: Documents of each language in the training sample (about), words of a training sequence, sequences, passes over them.
DOCS, LENGTH, SEQUENCES, PASSES = 500, 32, 6000, 3
#: Hashed features, words of a language's lexicon, words whose scores a worker keeps, characters of texts labelled together.
DIM, LEXICON, CACHE, TOGETHER = 1 << 16, 2000, 150_000, 1_500_000
#: Training sequences that change language in the middle, as code-switched text does.
SWITCHED = 0.4
UNKNOWN = "und"


def letter_runs(text: str | None) -> list[str]:
    words = LETTERS.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashed feature, first index of each word's) for the character pairs and triples of each word with its two edges,
    so affixes are features of their own. Words stand in one array of code points with a line feed between them."""
    c = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = c == 10
    at = np.flatnonzero(edge)[:-1]
    two = (c[:-1] * np.uint64(0x9E3779B1) + c[1:] * np.uint64(0x85EBCA6B)) % np.uint64(4294967291)
    three = (two[:-1] * np.uint64(0xC2B2AE35) + c[2:] * np.uint64(0x27D4EB2F) + np.uint64(7)) % np.uint64(4294967291)
    inside = ~edge[1:-1]
    first3 = at - np.arange(len(at))  # each word has one triple less than it has pairs
    return [((two % np.uint64(DIM)).astype(np.int64), at), ((three[inside] % np.uint64(DIM)).astype(np.int64), first3)]


@dataclass
class Crf:
    """Weights of hashed features and lexicons for each language, transitions, start scores."""

    langs: list[str]
    weights: np.ndarray
    lexicons: dict[str, int]
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """The words' scores by language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        out = self.lexicon_weights[[self.lexicons.get(w, 0) for w in words]].copy()
        for h, first in features(words):
            out += np.add.reduceat(self.weights[h], first, axis=0)
        return out

    def posteriors(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Each word's language probabilities."""
        a, _, b = self.forward_backward(scores)
        p = a * b
        p /= p.sum(1, keepdims=True)
        return np.split(p, np.cumsum([len(x) for x in scores])[:-1])

    def forward_backward(self, scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(forward, emission, backward) of all words of the texts, one after another, each up to a factor for its row.

        All texts step together, the longest first, so the number of steps is the longest text's.
        """
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        lengths = np.array([len(scores[i]) for i in order])
        most = int(lengths[0]) if len(lengths) else 0
        live = np.searchsorted(-lengths, -np.arange(most), side="left")  # texts longer than t
        t_of = np.concatenate([np.arange(n) for n in lengths]) if most else np.zeros(0, int)
        base = np.r_[0, np.cumsum(live)]
        slot = base[t_of] + np.repeat(np.arange(len(order)), lengths) if most else t_of
        flat = np.concatenate([scores[i] for i in order]) if most else np.zeros((0, len(self.langs)))
        e = np.empty_like(flat)
        e[slot] = np.exp(flat - flat.max(1, keepdims=True))
        trans = np.exp(self.transitions - self.transitions.max())
        a = np.empty_like(e)
        for t in range(most):
            x = e[base[t] : base[t + 1]]
            x = x * (np.exp(self.start - self.start.max()) if t == 0 else a[base[t - 1] : base[t - 1] + len(x)] @ trans)
            a[base[t] : base[t + 1]] = x / x.sum(1, keepdims=True)
        b = np.ones_like(e)
        for t in range(most - 2, -1, -1):
            n = live[t + 1]
            x = (b[base[t + 1] : base[t + 2]] * e[base[t + 1] : base[t + 2]]) @ trans.T
            b[base[t] : base[t] + n] = x / x.sum(1, keepdims=True)
        ends = np.r_[0, np.cumsum(lengths)]
        place = {i: k for k, i in enumerate(order)}
        back = np.concatenate([slot[ends[place[i]] : ends[place[i] + 1]] for i in range(len(scores))]) if most else slot
        return a[back], e[back], b[back]


def sequences(texts: list[tuple[int, list[str]]], rng: np.random.Generator, length: int = LENGTH, most: int = SEQUENCES) -> list[tuple[list[str], np.ndarray]]:
    """Runs of words with their labels: pieces of the texts, and texts that switch from one to another."""
    pieces = [(lang, words[i : i + length]) for lang, words in texts for i in range(0, len(words), length)]
    by: dict[int, list[list[str]]] = {}
    for lang, words in pieces:
        by.setdefault(lang, []).append(words)
    out, langs = [], sorted(by)
    for k in range(most):
        lang = langs[k % len(langs)]
        words = by[lang][rng.integers(len(by[lang]))]
        labels = np.full(len(words), lang)
        if len(langs) > 1 and rng.random() < SWITCHED:
            other = langs[(k + 1 + rng.integers(len(langs) - 1)) % len(langs)]
            more = by[other][rng.integers(len(by[other]))]
            cut, n = rng.integers(1, length // 2), rng.integers(1, length // 2)
            words, labels = words[:cut] + more[:n], np.r_[labels[:cut], np.full(len(more[:n]), other)]
        out.append((words, labels))
    return out


def train(rows: list[tuple[str, str]], seed: int = 5) -> Crf | None:
    """The model from (lang, text) rows: the log-likelihood's gradient by forward-backward, with a step for each weight that shrinks as it moves."""
    langs = sorted({lang for lang, _ in rows})
    texts = [(langs.index(lang), w) for lang, text in sorted(rows) if (w := letter_runs(text))]
    langs_seen = sorted({i for i, _ in texts})
    if not texts:
        return None
    if len(langs_seen) < len(langs):
        langs = [langs[i] for i in langs_seen]
        texts = [(langs_seen.index(i), w) for i, w in texts]
    n, rng = len(langs), np.random.default_rng(seed)
    counts = [Counter() for _ in langs]
    for i, w in texts:
        counts[i].update(w)
    member: dict[str, int] = {}
    for i, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            member[w] = member.get(w, 0) | 1 << i
    sets = {bits: k + 1 for k, bits in enumerate(sorted(set(member.values())))}
    crf = Crf(langs, np.zeros((DIM, n)), {w: sets[b] for w, b in member.items()}, np.zeros((len(sets) + 1, n)), np.zeros((n, n)), np.zeros(n))
    moved = {k: np.full(getattr(crf, k).shape, 1e-2) for k in ("weights", "lexicon_weights", "transitions", "start")}
    data = sequences(texts, rng)

    def step(name: str, gradient: np.ndarray, rate: float = 0.3) -> None:
        moved[name] += gradient**2
        getattr(crf, name).__iadd__(rate * gradient / np.sqrt(moved[name]))

    for _ in range(PASSES):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), 64):
            batch = [data[i] for i in order[lo : lo + 64]]
            flat = [w for words, _ in batch for w in words]
            scores = crf.emissions(flat)
            cuts = np.cumsum([len(words) for words, _ in batch])[:-1]
            a, e, b = crf.forward_backward(np.split(scores, cuts))
            post = a * b / (a * b).sum(1, keepdims=True)
            true = np.concatenate([labels for _, labels in batch])
            miss = -post
            miss[np.arange(len(true)), true] += 1
            gradient = np.zeros_like(crf.weights)
            for h, first in features(flat):
                np.add.at(gradient, h, np.repeat(miss, np.diff(np.r_[first, len(h)]), axis=0))
            step("weights", gradient / len(batch))
            gradient = np.zeros_like(crf.lexicon_weights)
            np.add.at(gradient, [crf.lexicons.get(w, 0) for w in flat], miss)
            step("lexicon_weights", gradient / len(batch))
            pair = np.ones(len(flat), bool)
            pair[np.r_[0, cuts]] = False
            to = np.flatnonzero(pair)
            joint = a[to - 1][:, :, None] * np.exp(crf.transitions)[None] * (e[to] * b[to])[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            seen = np.zeros((n, n))
            np.add.at(seen, (true[to - 1], true[to]), 1)
            step("transitions", (seen - joint.sum(0)) / len(batch))
            step("start", miss[np.r_[0, cuts]].sum(0) / len(batch))
    return crf


def sample(docs: DataFrame, most: int = DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """About ``most`` (lang, text) rows of each language, chosen by a hash of id and text; the bound is on rows, texts are whole."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).bitwiseAND(F.lit(2**63 - 1)).alias("h")).dropna(subset=["lang", "text"])
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, most / n) * 2**63) - 1)])
    return [(r.lang, r.text) for r in rows.where(F.col("h") <= share[F.col("lang")]).select("lang", "text").collect()]


def word_posteriors(texts: list[str | None], crf: Crf | None, cache: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, its words' language probabilities) of each text that has words; cache keeps words' emissions between calls."""
    order = sorted((i for i, t in enumerate(texts) if crf and t), key=lambda i: -len(texts[i]))
    while order:
        n, total = 0, 0
        while n < len(order) and (n == 0 or total + len(texts[order[n]]) <= TOGETHER):
            total += len(texts[order[n]])
            n += 1
        part, order = [(i, w) for i in order[:n] if (w := letter_runs(texts[i]))], order[n:]
        if not part:
            continue
        codes, unique = pd.factorize(np.array([w for _, words in part for w in words], object))
        fresh = [w for w in unique if w not in cache]
        if len(cache) + len(fresh) > CACHE:
            cache.clear()
            fresh = list(unique)
        cache.update(zip(fresh, crf.emissions(fresh), strict=True))
        e = np.stack([cache[w] for w in unique])[codes]
        for (i, _), p in zip(part, crf.posteriors(np.split(e, np.cumsum([len(words) for _, words in part])[:-1])), strict=True):
            yield i, p


def judge(texts: list[str | None], crf: Crf | None, cache: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Each text's language and score; cache keeps words' emissions between calls."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for i, p in word_posteriors(texts, crf, cache):
        mean = p.mean(0)
        langs[i], scores[i] = crf.langs[int(mean.argmax())], min(1.0, float(mean.max()))
    return langs, scores


def confidence(texts: list[str | None], crf: Crf | None, cache: dict[str, np.ndarray]) -> np.ndarray:
    """Each text's mean over words of the word's most probable language's probability, whichever that is; 0 without words."""
    out = np.zeros(len(texts))
    for i, p in word_posteriors(texts, crf, cache):
        out[i] = p.max(1).mean()
    return out


def label_documents(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row: the language with the most probability over the text's words, and its mean.

    A text that is null or has no letter, and any text where no language was learned, is ``und`` with score 0. Words are
    runs of letters, lower-cased; the whole text is labelled; ties go to the first language by name; ids may be null or
    repeated; an empty table gives no rows; other columns are not looked at.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        for b in batches:
            langs, scores = judge(b.column(1).to_pylist(), crf, cache)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    rows = settled(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(trimmed(each), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, crf: Crf | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose words have a language, each its own: the mean of their best probabilities is ``least``
    or more. So a text in several languages stays; one without letters, or where no language was learned, goes."""
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        for b in batches:
            sure = confidence(b.column(at).to_pylist(), crf, cache)
            yield b.filter(pa.array((sure > 0) & (sure >= least)))

    return settled(docs).mapInArrow(trimmed(each), docs.schema)
