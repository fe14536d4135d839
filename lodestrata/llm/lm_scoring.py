"""Language-model scores by online logistic context mixing.

A token is coded by binary decisions. The most frequent training tokens, the end of a text among them, and one symbol
for all rarer tokens are leaves of a Huffman tree; a rarer token is then spelled by the bits of its bytes and a closing
space, which its discounted share of the training tokens backs.

- Each decision of the tree is predicted by several hashed contexts: none, the token before and the two before, counted over all
  training texts; none, as the text itself has decided so far; and, where three tokens before and what followed
  them stand elsewhere in the corpus, the token that followed there. A mixer combines them in the logistic domain with weights
  that a gate selects (the depth in the tree, and how well the match has held); weights, the text's own counts and a final
  refinement by the mixed probability learn after every few tokens, through the whole text.
- Matches are a distributed table: for one context in MATCH_EVERY, chosen by its hash, the tokens that follow. It grows with the
  corpus without a bound and meets each chunk by a join; the tree and the counted tables grow with it up to a stated size.
- Spelling is predicted by contexts of one to five bytes, counted over the distinct rarer tokens and mixed by weights
  that the position in the byte and the number of known contexts gate. Its value depends on the token alone, so each distinct
  token is spelled once for the whole corpus.

All counts, of tokens, contexts and matches, are over all training texts, and the weights that mix the spelling's contexts are fitted on all
rarer training tokens; the mixer of the tree starts from constants and learns in each text.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, removed, settled, stored, trimmed, words_of

#: Leaves of the tree and slots of a context table, at least and at most: between them they grow with the training tokens (the tree with their root).
FREQUENT, MOST_FREQUENT, SLOTS, MOST_SLOTS, TOKENS_PER_SLOT = 4095, 65_535, 1 << 20, 1 << 23, 64
#: Tokens of a match's context, one context in so many has an entry, tokens that it foretells.
MATCH_CONTEXT, MATCH_EVERY, MATCH_AHEAD = 3, 16, 16
#: Slots of a text's own predictor, texts that are mixed together, decisions of a step (about), tokens of a text in its first steps.
LOCAL, TEXTS, TOGETHER, STEPS = 1024, 512, 400_000, (4, 4, 8, 16, 32)
#: Orders of the spelling contexts, slots of each.
ORDERS, SPELL_SLOTS = (1, 2, 3, 4, 5), 1 << 19
#: Counts that travel as one row, words that are spelled at once.
BLOCK, SPELLED = 1 << 16, 5000
DEPTHS, MATCHES = 16, 3
GATES = DEPTHS * MATCHES
#: Where the weights of the inputs start: prior, one and two tokens before, the text's own counts, the match.
START = (0.3, 0.45, 0.45, 0.25, 1.0)
INPUTS = len(START)
RATE, REFINE_RATE, BINS = 0.02, 0.02, 24
#: What a match says of a bit, in the logistic domain, when it has just begun and when it has held for a while; and prior (hits, misses) of each.
MATCH_SAYS, MATCH_PRIOR = (0.0, 2.0, 4.0), ((0, 1), (3, 1), (19, 1))
#: Rarer tokens on which the fit of the spelling's weights begins (about), text bytes of a chunk (about).
WORDS, CHUNK_BYTES = 6000, 10_000_000
#: Passes over all rarer tokens that the fit may take, and the gain (nats a token) of a Newton step below which it is the last: it leaves far less than it gains.
PASSES, SETTLED = 12, 0.05
END = b" "


def tokens_of(text: str | None) -> list[bytes]:
    return [*words_of(text), END]


def rare_class(token: bytes) -> int:
    """What a context keeps of a rarer token: minus a class of its first two bytes."""
    return -1 - (token[0] * 31 + (token[1] if len(token) > 1 else 0)) % 1021


class Symbols(dict):
    """Tokens' symbols; a rarer token's class is kept once found, up to a bound."""

    def __missing__(self, token: bytes) -> int:
        c = rare_class(token)
        if len(self) < 400_000:
            self[token] = c
        return c


def frequent(tokens: int) -> int:
    """Leaves of the tree for so many training tokens."""
    return int(np.clip(0.6 * max(0, tokens) ** 0.5, FREQUENT, MOST_FREQUENT))


def slot_count(tokens: int) -> int:
    """Slots of a context table for so many training tokens: a power of two."""
    return int(np.clip(1 << int(np.ceil(np.log2(max(1, tokens / TOKENS_PER_SLOT)))), SLOTS, MOST_SLOTS))


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def counted(n: np.ndarray) -> np.ndarray:
    """Stretched probability of a one from the counts (zeros, ones) in the last axis; 0 where nothing was counted."""
    zeros, ones = n[..., 0].astype(np.float32), n[..., 1].astype(np.float32)
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))


def mixed_hash(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(29))
    return h


@dataclass
class Tree:
    """A Huffman code: symbol 0 is any rarer token, symbol i + 1 is words[i]. Of each symbol the nodes and bits on its path."""

    words: list[bytes]
    first: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    depth: np.ndarray
    prior: np.ndarray

    @staticmethod
    def over(words: list[bytes], counts: list[int], rare: int) -> Tree:
        weight = [rare + 1, *(c + 1 for c in counts)]
        heap = [(w, i, None) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        inner: list[tuple[int, int]] = []
        total, ids = len(weight), {}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            node = len(inner)
            inner.append((a[1], b[1]))
            ids[total + node] = (a[0], b[0])
            heapq.heappush(heap, (a[0] + b[0], total + node, None))
        paths: list[list[tuple[int, int]]] = [[] for _ in weight]
        todo = [(heap[0][1], [])]
        while todo:
            x, path = todo.pop()
            if x < total:
                paths[x] = path
            else:
                for bit, child in enumerate(inner[x - total]):
                    todo.append((child, [*path, (x - total, bit)]))
        first = np.r_[0, np.cumsum([len(p) for p in paths])]
        flat = [s for p in paths for s in p] or [(0, 0)]
        prior = np.array([stretch(np.float64(ids[total + n][1]) / sum(ids[total + n])) for n in range(len(inner))] or [0.0], np.float32)
        depth = np.concatenate([np.arange(len(p)) for p in paths]) if flat else np.zeros(1)
        return Tree(words, first, np.array([n for n, _ in flat], np.int32), np.array([b for _, b in flat], np.int8), np.minimum(depth, DEPTHS - 1).astype(np.int8), prior)

    def symbols(self) -> Symbols:
        return Symbols({w: i + 1 for i, w in enumerate(self.words)})


@dataclass
class Tokens:
    """Texts' tokens, one after another: symbol, hash of what came before for either context table, number of decisions; their
    numbers in a vocabulary, if they came by way of one."""

    symbols: np.ndarray
    before: tuple[np.ndarray, np.ndarray]
    n: np.ndarray
    numbers: np.ndarray

    @staticmethod
    def of(tree: Tree, symbols: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> Tokens:
        """symbols: rarer tokens as minus their class; starts: True at a text's first token, which has no token before."""
        one = np.r_[0, symbols[:-1]].astype(np.int64)[: len(symbols)]
        one = np.where(one < 0, one + (1 << 32), one + 1)
        one[starts] = 0
        two = np.r_[0, one[:-1]][: len(one)]
        two[starts] = 0
        symbols = np.maximum(symbols, 0).astype(np.int32)
        return Tokens(symbols, (mixed_hash(one, 1), mixed_hash(one, two, 2)), (tree.first[symbols + 1] - tree.first[symbols]).astype(np.int32), numbers)


@dataclass
class Decisions:
    """The tree decisions of tokens: rows of node, bit, gate and slots in the two context tables; first of each token, and the end."""

    node: np.ndarray
    bit: np.ndarray
    gate: np.ndarray
    slots: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(tree: Tree, t: Tokens, which: np.ndarray | slice, size: int) -> Decisions:
        n = t.n[which]
        first = np.r_[0, np.cumsum(n, dtype=np.int64)]
        at = np.repeat(tree.first[t.symbols[which]] - first[:-1], n) + np.arange(first[-1])
        node = tree.nodes[at]
        step = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        shift = np.uint64(64 - size.bit_length() + 1)
        slots = np.empty((2, len(node)), np.int32)
        for k in (0, 1):
            h = np.repeat(t.before[k][which], n)
            h ^= step
            h *= np.uint64(0x9E3779B97F4A7C15)
            h >>= shift
            slots[k] = h
            slots[k] += k * size
        return Decisions(node, tree.bits[at], tree.depth[at], slots, first)


@dataclass
class Match:
    """Of each token: the symbol that a match foretells and the state of the match (0: none)."""

    symbols: np.ndarray
    state: np.ndarray

    def says(self, tree: Tree, which: np.ndarray, n: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(input, state) of each of the n decisions of the tokens: towards the foretold symbol's bit where the node is on its path."""
        state = np.repeat(self.state[which], n)
        k = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)
        told = np.repeat(self.symbols[which], n)
        at = np.minimum(tree.first[told] + k, len(tree.nodes) - 1)
        on = (state > 0) & (tree.first[told] + k < tree.first[told + 1]) & (tree.nodes[at] == node)
        state = np.where(on, state, 0)
        return (np.array(MATCH_SAYS, np.float32)[state] * (2 * tree.bits[at] - 1)).astype(np.float32), state


def mix_texts(tree: Tree, t: Tokens, first: np.ndarray, table: np.ndarray, match: Match | None = None) -> np.ndarray:
    """log10 probability of each text's symbols. first: the tokens at which texts begin, and the end. table: the stretched counts of both contexts.

    Texts step together, a few tokens of each at a time: predictions of a step use what was learned in all steps before it, and then the
    step's errors move the text's weights, counts and refinement. So each text learns through its whole length, and what a
    step does is a few array operations however many texts there are. Texts of like length are mixed together.
    """
    size, lengths = len(table) // 2, np.diff(first)
    out, order = np.zeros(len(lengths)), np.argsort(-lengths, kind="stable")
    for lo in range(0, len(order), TEXTS):
        own = order[lo : lo + TEXTS]
        long, m = lengths[own], len(own)
        w = np.repeat(np.array(START, np.float32)[:, None], m * GATES, 1)  # by input, then text and gate
        counts = np.zeros(2 * m * LOCAL, np.float32)
        refine = np.tile((np.arange(BINS + 1) / BINS).clip(0.005, 0.995).astype(np.float32), m)
        done, step = 0, 0
        while len(alive := np.flatnonzero(long > done)):
            wide = max(1, min(STEPS[min(step, len(STEPS) - 1)], TOGETHER // (8 * len(alive))))
            some = np.minimum(long[alive] - done, wide)
            which = np.repeat(first[own[alive]] + done - (np.cumsum(some) - some), some) + np.arange(some.sum())
            done, step = done + wide, step + 1
            d = Decisions.of(tree, t, which, size)
            if not len(d.node):  # a tree of one leaf decides nothing
                continue
            n = t.n[which]
            first_of = np.cumsum(some) - some
            here = np.repeat(np.arange(len(alive)), np.add.reduceat(n, first_of))  # among those alive
            x = np.empty((INPUTS, len(here)), np.float32)
            x[0], x[1], x[2] = tree.prior.take(d.node), table.take(d.slots[0]), table.take(d.slots[1])
            at = alive.take(here) * LOCAL
            at += d.node % LOCAL
            at *= 2
            np.log((counts.take(at + 1) + np.float32(0.4)) / (counts.take(at) + np.float32(0.4)), out=x[3])
            gate = d.gate * np.int64(MATCHES)
            x[4] = 0
            if match is not None and (told := np.flatnonzero(match.state[which])).size:
                row = np.repeat(d.first[told], n[told]) + np.arange(n[told].sum()) - np.repeat(np.cumsum(n[told]) - n[told], n[told])
                x[4, row], state = match.says(tree, which[told], n[told], d.node[row])
                gate[row] += state
            y, key = d.bit.astype(np.float32), here * GATES + gate
            base = alive.take(here)
            of = base * GATES + gate
            dot = w[0].take(of) * x[0]
            for i in range(1, INPUTS):
                dot += w[i].take(of) * x[i]
            p = 1 / (1 + np.exp(-dot.clip(-14, 14)))
            bin_ = (p * BINS + np.float32(0.5)).astype(np.int64)
            final = (0.7 * p + 0.3 * refine.take(base * (BINS + 1) + bin_)).clip(1e-6, 1 - 1e-6)
            out[own[alive]] += np.bincount(here, np.log(1 - np.abs(y - final)), len(alive))
            miss, wide_key = y - p, len(alive) * GATES
            seen = np.bincount(key, minlength=wide_key)
            pull = RATE / np.maximum(1, seen / 16)  # a step in which a gate decides often counts as sixteen decisions
            to = (alive[:, None] * GATES + np.arange(GATES)).ravel()
            for i in range(INPUTS):
                w[i][to] += (np.bincount(key, miss * x[i], wide_key) * pull).astype(np.float32)
            np.add.at(counts, at + d.bit, np.float32(1))
            key, to = here * (BINS + 1) + bin_, (alive[:, None] * (BINS + 1) + np.arange(BINS + 1)).ravel()
            seen, ones, r = np.bincount(key, minlength=len(to)), np.bincount(key, y, len(to)), refine[to]
            refine[to] = r + (1 - (1 - REFINE_RATE) ** seen) * (ones / np.maximum(1, seen) - r)
    return out / np.log(10)


def context_entries(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, what follows) of the chosen contexts of texts, one after another: a token's context are those before it in its
    text, what follows is it and those after it, as 32 bits of their hashes, 0 beyond the text."""
    n = len(hashes)
    lengths = np.diff(first)
    place, end = np.arange(n) - np.repeat(first[:-1], lengths), np.repeat(first[1:], lengths)
    before = [np.r_[np.zeros(k, np.uint64), hashes[: max(0, n - k)]][:n] for k in range(1, MATCH_CONTEXT + 1)]
    context = mixed_hash(*before)
    at = np.flatnonzero((place >= MATCH_CONTEXT) & (context % np.uint64(MATCH_EVERY) == 0))
    ahead = at[:, None] + np.arange(MATCH_AHEAD)
    short = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    follow = np.where(ahead < end[at][:, None], short[np.minimum(ahead, max(0, n - 1))] if n else 0, 0).astype(np.uint32)
    return at, context[at].view(np.int64), follow


def match_of(tree: Tree, tops: np.ndarray, symbols: np.ndarray, hashes: np.ndarray, first: np.ndarray, trained: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[Match, np.ndarray]:
    """(matches, whether each token is the one foretold). known: sorted contexts, what follows each, how many training texts say so.

    A training text's own occurrence is taken out. tops: short hashes of the tree's words, by symbol. A prediction holds as long as
    what was foretold before it came; of several the one from the nearest context counts.
    """
    n = len(hashes)
    told, state = np.zeros(n, np.uint32), np.zeros(n, np.int8)
    short = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    contexts, follow, times = known
    at, context, mine = context_entries(hashes, first)
    if len(at) and len(contexts):
        k = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        same = (follow[k] == mine).all(1)
        left = times[k] - (same & np.repeat(trained, np.diff(first))[at])
        use = (contexts[k] == context) & (left > 0)
        at, mine, foretold = at[use], mine[use], follow[k[use]]
        held = np.logical_and.accumulate(np.c_[np.ones(len(at), bool), (foretold == mine)[:, :-1]], axis=1) & (foretold > 0) & (mine > 0)
        for o in range(MATCH_AHEAD - 1, -1, -1):
            row = np.flatnonzero(held[:, o])
            told[at[row] + o], state[at[row] + o] = foretold[row, o], 1 + (o >= 4)
    came = (state > 0) & (told == short)
    by = np.argsort(tops)
    k = np.minimum(np.searchsorted(tops[by], told), len(tops) - 1) if len(tops) else np.zeros(n, np.int64)
    guess = np.where(tops[by][k] == told, by[k] + 1, 0) if len(tops) else np.zeros(n, np.int64)
    return Match(np.where(came, symbols, guess).astype(np.int64), state), came


def rare_with_match(tail: np.ndarray, rare: np.ndarray, match: Match, came: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probabilities of rarer tokens where a match foretells one: the part of the state's foretold rarer tokens that came in the text so
    far goes to the token, the rest to all by ``tail``."""
    tail = tail.copy()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for state in (1, 2):
        at = np.flatnonzero(rare & (match.state == state) & (match.symbols == 0))
        if len(at):
            new = np.flatnonzero(np.r_[True, text[at][1:] != text[at][:-1]])
            begin = np.repeat(new, np.diff(np.r_[new, len(at)]))
            hits = np.cumsum(came[at]) - came[at]
            hits = hits - hits[begin]
            tried, (a, b) = np.arange(len(at)) - begin, MATCH_PRIOR[state]
            part = (a + hits) / (a + b + tried)
            tail[at] = np.log10(np.where(came[at], part, 0) + (1 - part) * 10.0 ** tail[at])
    return tail


def spelled_bits(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, bit, position in the byte, slots by order) of all bits of all words, each closed by a space."""
    flat = np.frombuffer(b"".join(w + b" " for w in words), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 1 for w in words])
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    place = np.arange(len(flat)) - np.repeat(first, lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    context, contexts = np.zeros(len(flat), np.uint64), []
    for o in range(1, max(ORDERS) + 1):
        before = np.where(place >= o, flat[np.maximum(0, np.arange(len(flat)) - o)] + np.uint64(1), np.uint64(0))
        context = mixed_hash(context, before)
        if o in ORDERS:
            contexts.append(mixed_hash(context, o))
    bits = (flat[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)
    prefix = np.concatenate([np.ones((len(flat), 1), np.uint64), (flat[:, None] | np.uint64(256)) >> np.arange(7, 0, -1, dtype=np.uint64)], 1)
    step, shift = prefix * np.uint64(0xD6E8FEB86659FD93), np.uint64(64 - SPELL_SLOTS.bit_length() + 1)
    slots = np.empty((len(ORDERS), prefix.size), np.int32)
    for k, c in enumerate(contexts):
        h = c[:, None] ^ step
        h *= np.uint64(0x9E3779B97F4A7C15)
        h >>= shift
        slots[k] = h.ravel()
        slots[k] += k * SPELL_SLOTS
    return np.repeat(word, 8), bits.ravel().astype(np.int8), np.tile(np.arange(8), len(flat)), slots


def spelling_gate(place: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which weights hold: by the position in the byte and how many of the contexts have been seen."""
    return place * (len(ORDERS) + 1) + (x != 0).sum(0)


def spell(words: list[bytes], table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log10 probability of each word's spelling."""
    out = np.zeros(len(words))
    for lo in range(0, len(words), SPELLED):
        part = words[lo : lo + SPELLED]
        word, bit, place, slots = spelled_bits(part)
        x = table[slots]
        w = weights[spelling_gate(place, x)]
        dot = np.clip((w[:, :-1].T * x).sum(0) + w[:, -1], -14, 14)
        out[lo : lo + len(part)] = -np.bincount(word, np.logaddexp(0, np.where(bit > 0, -dot, dot)), len(part)) / np.log(10)
    return out


def spelling_left(counts: np.ndarray) -> np.ndarray:
    """Of each slot what is ``counted`` when one zero, or one one, is taken out: single precision, made a part at a time."""
    out = np.zeros((len(counts), 2), np.float32)
    for lo in range(0, len(counts), BLOCK):
        for bit in (0, 1):
            n = counts[lo : lo + BLOCK].astype(np.float32)
            n[:, bit] -= 1
            out[lo : lo + BLOCK, bit] = counted(np.maximum(n, 0))
    return out


def spelling_inputs(words: list[bytes], left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs with the bias, bit, gate) of all bits of the words. Each word is taken out of the counts first (``spelling_left``), so it is judged as a new word would be."""
    _, bit, place, slots = spelled_bits(words)
    x = np.ones((len(bit), len(ORDERS) + 1), np.float32)
    flat = left.ravel()
    for k, s in enumerate(slots):
        x[:, k] = flat.take(s * np.int32(2) + bit)
    return x, bit, spelling_gate(place, x[:, :-1].T)


def spelling_sums(x: np.ndarray, bit: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each gate the log likelihood's gradient at the weights and, row by row, its negated second derivative; they add up over words."""
    width = x.shape[1]
    out = np.zeros((len(weights), width + 1, width))
    order = np.argsort(gate.astype(np.uint8), kind="stable")  # 48 gates: a radix sort
    cuts = np.searchsorted(gate[order], np.arange(len(weights) + 1))
    for g in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[g] : cuts[g + 1]]
        xg = x[own].astype(np.float64)
        p = 1 / (1 + np.exp(-np.clip(xg @ weights[g], -14, 14)))
        out[g, 0], out[g, 1:] = xg.T @ (bit[own] - p), (xg * (p * (1 - p))[:, None]).T @ xg
    return out


def spelling_step(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The weights after a short Newton step by the sums of all words, with a slight pull to 0.3."""
    out = weights.copy()
    for g in np.flatnonzero(sums.any((1, 2))):
        step = np.linalg.solve(sums[g, 1:] + 10 * np.eye(sums.shape[2]), sums[g, 0] - 10 * (weights[g] - 0.3))
        out[g] = np.clip(weights[g] + step * min(1.0, 0.3 / max(1e-9, np.abs(step).max())), -0.5, 1.5)
    return out


def spelling_weights(words: list[bytes], counts: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Mixing weights by gate (last: bias) of some words: logistic regression on their bits."""
    weights = np.full((8 * (len(ORDERS) + 1), len(ORDERS) + 1), 0.3)
    weights[:, -1] = 0
    if words:
        left = spelling_left(counts)
        inputs = [spelling_inputs(words[lo : lo + SPELLED // 5], left) for lo in range(0, len(words), SPELLED // 5)]
        for _ in range(passes):
            weights = spelling_step(weights, sum(spelling_sums(*some, weights) for some in inputs))
    return weights


def fitted_weights(rare: DataFrame, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """spelling_weights of all tokens of ``rare``, from these weights on: a pass over them for each step, until a step gains less than SETTLED.

    A task adds up its tokens' sums, which meet by gate, so the driver gets a fixed number of rows. They are rounded, so the order in which they were added doesn't show.
    The counts go to all tasks once, not with each pass.
    """
    shape = (len(weights), weights.shape[1] + 1, weights.shape[1])
    left = rare.sparkSession.sparkContext.broadcast(spelling_left(counts))

    for _ in range(PASSES):

        def sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(shape), 0
            for b in larger(batches, SPELLED):
                some = b.column("token").to_pylist()
                n += len(some)
                for lo in range(0, len(some), SPELLED):
                    total += spelling_sums(*spelling_inputs(some[lo : lo + SPELLED], left.value), weights)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, total.ravel()[at]])], names=["at", "v"])

        total, n = np.zeros(shape), 0
        for r in rare.select("token").mapInArrow(trimmed(sums), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            if r["at"] < 0:
                n = r["v"]
            else:
                total.ravel()[r["at"]] = r["v"]
        pull, bend = total[:, 0] - 10 * (weights - 0.3) * total.any((1, 2))[:, None], total[:, 1:] + 10 * np.eye(shape[2])
        gain = (pull * np.linalg.solve(bend, pull[..., None])[..., 0]).sum() / 2
        weights = np.round(spelling_step(weights, total), 6)
        if gain <= SETTLED * n:
            break
    left.destroy()
    return weights


def rare_log10(c: np.ndarray, spelled: np.ndarray, n_rare: int, v_rare: int, discount: float) -> np.ndarray:
    """log10 probability of a rarer token: its discounted share of their training occurrences, and for what the discounts leave, its spelling."""
    with np.errstate(divide="ignore"):
        share = np.log(np.maximum(c - discount, 0) / max(1, n_rare))
        left = np.log(discount * v_rare / n_rare if n_rare else 1.0)
        return np.logaddexp(share, left + spelled * np.log(10)) / np.log(10)


class Tally:
    """How often each of ``size`` numbers was added."""

    def __init__(self, size: int):
        self.counts = np.zeros(size, np.int32)

    def add(self, slots: np.ndarray, bit: np.ndarray) -> None:
        """Counts slot * 2 + bit; slots: a row for each context."""
        for row in slots:
            np.add.at(self.counts, row.astype(np.int64) * 2 + bit, np.int32(1))


def larger(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches put together until they hold ``rows`` rows; for short rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def count_blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counts as rows of BLOCK numbers, without blocks of zeros."""
    for block, part in enumerate(counts.reshape(-1, BLOCK)):
        if part.any():
            packed = pa.compress(part.astype(np.uint32).tobytes(), "zstd", asbytes=True)  # of one task, so below 2**32
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=["block", "n"])


def gathered(parts: DataFrame, size: int, stretched: bool = False) -> np.ndarray:
    """The sums of rows (block, n) as an array (size, 2) of zeros and ones or, stretched, as what is ``counted`` of each slot, which tasks
    make of whole blocks. A fixed number of slots goes to the driver, packed, in numbers of 32 bits; counts above that stay at the most."""
    kind, width = (np.float32, BLOCK // 2) if stretched else (np.int32, BLOCK)

    def total(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(BLOCK, np.int64)
        for n in group["n"]:
            out += np.frombuffer(pa.decompress(n, 4 * BLOCK, "zstd", asbytes=True), np.uint32)
        out = counted(out.reshape(-1, 2)) if stretched else np.minimum(out, 2**31 - 1).astype(kind)
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "n": [pa.compress(out.tobytes(), "zstd", asbytes=True)]})

    out = np.zeros(size if stretched else 2 * size, kind)
    for r in parts.groupBy("block").applyInPandas(total, "block int, n binary").collect():
        out[r.block * width : (r.block + 1) * width] = np.frombuffer(pa.decompress(r.n, 4 * width, "zstd"), kind)
    release()
    return out if stretched else out.reshape(size, 2)


class Numbers(dict):
    """Tokens' numbers in order of appearance; hashes has their XXH64."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, token: bytes) -> int:
        self[token] = k = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(token, 11))
        return k


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their chunk: neighbours in a partition, CHUNK_BYTES of text together. Copies are no matter, nor is one long text."""
    begun, base = 0, TaskContext.get().partitionId() << 32
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column("text").cast(pa.large_binary())), 0)).astype(np.int64) + 16
        before = begun + np.cumsum(size) - size
        begun += int(size.sum())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base + before // CHUNK_BYTES)], names=[*b.schema.names, "chunk"])


def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of a chunk's rows (a task may read a part of a chunk): its tokens with their training count, and its chosen contexts
    with what follows and how many texts, and training texts, say so."""
    numbers, counts, last = Numbers(), np.zeros(0, np.int64), None
    names = ["chunk", "token", "n", "context", "follow", "trained"]

    def tokens_so_far() -> Iterator[pa.RecordBatch]:
        words = list(numbers)
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            none = [pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary()), pa.nulls(len(part), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), last)), pa.array(part, pa.binary()), pa.array(counts[lo : lo + 50_000]), *none], names=names)

    for b in batches:
        chunk = b.column("chunk").to_numpy()
        cuts = np.r_[0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, len(chunk)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if chunk[lo] != last:
                yield from tokens_so_far()
                numbers, counts, last = Numbers(), np.zeros(0, np.int64), int(chunk[lo])
            lists = [np.fromiter(map(numbers.__getitem__, tokens_of(x.as_py())), np.int64) for x in b.column("text").slice(lo, hi - lo)]
            train = ~np.asarray(b.column("held_out").slice(lo, hi - lo).to_numpy(zero_copy_only=False), bool)
            lengths = np.array([len(x) for x in lists])
            flat = np.concatenate(lists)
            more = np.bincount(flat[np.repeat(train, lengths)], minlength=len(numbers))
            more[: len(counts)] += counts
            counts = more
            at, context, follow = context_entries(np.array(numbers.hashes, np.uint64)[flat], np.r_[0, np.cumsum(lengths)])
            if len(at):
                rows = np.c_[context.view(np.uint32).reshape(-1, 2), follow]
                distinct, which = np.unique(rows, axis=0, return_inverse=True)
                n, trained = np.bincount(which.ravel()), np.bincount(which.ravel(), np.repeat(train, lengths)[at]).astype(np.int64)
                context, follow = np.ascontiguousarray(distinct[:, :2]).view(np.int64).ravel(), np.ascontiguousarray(distinct[:, 2:])
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * MATCH_AHEAD), len(follow), [None, pa.py_buffer(follow.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), last)), pa.nulls(len(n), pa.binary()), pa.array(n), pa.array(context), packed, pa.array(trained)], names=names)
    yield from tokens_so_far()


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of docs.

    The model learns from the rows for which ``held_out`` is not true. base_score is the add-one unigram model's log10
    probability of the row's tokens, score this model's.

    Neighbouring rows are chunks of about CHUNK_BYTES, whatever they hold, so copies make no chunk large. A chunk gives each
    distinct token once with its training count, and its chosen contexts with what follows them. Counts meet by token, where a
    frequent token has a row for each chunk at most; contexts meet by context, combined before they are shuffled, and keep what follows in
    most training texts. Held-out texts say which contexts are looked up, never which of them foretell something or what: a held-out row's
    score is the same whatever other held-out rows there are. Both return to their chunks by joins. What goes to the driver
    and back to all tasks has a stated greatest size: the tree's words and the hashed tables.

    A null text is the empty one, which is one end; rows with null or repeated ids are scored each by itself; without any training row
    the counts are zero and all tokens are spelled; an empty table gives no rows; other columns are not looked at.
    """
    spark = settled(docs).sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = stored(rows.mapInArrow(chunked, "doc_id long, text string, held_out boolean, chunk long"), "chunks")
    local = stored(rows.select("chunk", "text", "held_out").mapInArrow(trimmed(vocabulary), "chunk long, token binary, n long, context long, follow binary, trained long"), "vocabulary")
    words, entries = local.where("token is not null").select("chunk", "token", "n"), local.where("context is not null")
    sure = entries.groupBy("context", "follow").agg(F.sum("n").alias("n"), F.sum("trained").alias("times"))
    best = F.max(F.when(F.col("times") > 0, F.struct("times", "follow"))).alias("b")  # by training texts alone
    sure = sure.groupBy("context").agg(F.sum("n").alias("n"), best).where("n > 1 and b is not null")  # one met once foretells nothing but itself
    sure = stored(sure.select("context", "b.times", "b.follow"), "contexts")
    matches = stored(entries.select("chunk", "context").join(sure, "context"), "matches")
    known = stored(words.groupBy("token").agg(F.sum("n").alias("c")), "tokens")
    totals = known.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).first()
    n_train, v_train = totals.n or 0, totals.v or 0
    size = slot_count(n_train)
    top = sorted(known.where("c > 1").orderBy(F.desc("c"), "token").limit(frequent(n_train)).collect(), key=lambda r: (-r.c, bytes(r.token)))
    tree = Tree.over([bytes(r.token) for r in top], [r.c for r in top], n_train - sum(r.c for r in top))
    symbol = tree.symbols()
    n_rare, v_rare = n_train - sum(r.c for r in top), v_train - len(top)
    discount = min(0.95, max(0.05, (totals.n1 or 0) / max(1, (totals.n1 or 0) + 2 * (totals.n2 or 0))))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Tally(4 * size)
        for b in batches:
            t, _ = read(b.column("text").to_pylist(), tree, symbol.__getitem__)
            for lo in range(0, len(t.symbols), TOGETHER // 4):
                d = Decisions.of(tree, t, slice(lo, lo + TOGETHER // 4), size)
                counts.add(d.slots, d.bit)
        yield from count_blocks(counts.counts)

    def spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Tally(2 * len(ORDERS) * SPELL_SLOTS)
        for b in larger(batches, SPELLED):
            some = b.column("token").to_pylist()
            for lo in range(0, len(some), SPELLED):
                _, bit, _, slots = spelled_bits(some[lo : lo + SPELLED])
                counts.add(slots, bit)
        yield from count_blocks(counts.counts)

    table = gathered(rows.where("not held_out").select("text").mapInArrow(trimmed(contexts), "block int, n binary"), 2 * size, stretched=True)
    rare = known.where("c > 0")
    if top:
        rare = rare.where((F.col("c") < top[-1].c) | ((F.col("c") == top[-1].c) & (F.col("token") > F.lit(bytes(top[-1].token)))))
    spell_counts = gathered(rare.mapInArrow(trimmed(spellings), "block int, n binary"), len(ORDERS) * SPELL_SLOTS)
    spell_table = counted(spell_counts)
    bound = int(min(1.0, WORDS / max(1, v_train)) * 2**63) - 1
    some = rare.where(F.xxhash64("token", F.lit(1)).bitwiseAND(F.lit(2**63 - 1)) <= bound).limit(2 * WORDS).collect()  # only where the fit begins
    letters = spelling_weights(sorted(bytes(r.token) for r in some), spell_counts)
    release()
    letters = fitted_weights(rare, spell_counts, letters)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in larger(batches, SPELLED):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spell(b.column("token").to_pylist(), spell_table, letters))], names=[*b.schema.names, "spelled"])

    full = stored(known.mapInArrow(trimmed(spelled), "token binary, c long, spelled double"), "spelled")
    returned = words.select("chunk", "token").join(full, "token").select("chunk", "token", "c", "spelled", F.lit(0).cast("long").alias("context"), F.lit(None).cast("binary").alias("follow"))
    foretold = matches.select("chunk", F.lit(None).cast("binary").alias("token"), F.col("times").alias("c"), F.lit(0.0).alias("spelled"), "context", "follow")
    returned = stored(returned.unionByName(foretold), "returned")
    for used in (local, sure, matches, known, full):
        removed(used)  # all of them is in ``returned``
    del spell_counts
    tops = np.array([xxhash.xxh64_intdigest(w, 11) >> 32 | 1 for w in tree.words], np.uint32)

    def score(group: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")})
        is_word = right["token"].notna().to_numpy()
        vocab, told = right[is_word], right[~is_word]
        place = {t: i for i, t in enumerate(vocab["token"])}
        c, tail = vocab["c"].to_numpy(), vocab["spelled"].to_numpy()
        hashes = np.fromiter((xxhash.xxh64_intdigest(t, 11) for t in place), np.uint64, len(place))
        base = np.log10((c + 1) / (n_train + v_train + 1))
        symbols = np.fromiter((symbol[t] for t in vocab["token"]), np.int64, len(vocab))
        is_rare = symbols < 0
        tail = np.where(is_rare, rare_log10(c, tail, n_rare, v_rare, discount), 0.0)
        texts = group["text"].tolist()
        t, first = read(texts, tree, place.__getitem__, symbols)
        add = lambda v: np.add.reduceat(v, first[:-1])
        tokens, known_, base_ = np.diff(first), add((c > 0).astype(np.int64)[t.numbers]), add(base[t.numbers])
        _, one = np.unique(told["context"].to_numpy(), return_index=True)
        told = told.iloc[one]
        follow = np.frombuffer(b"".join(told["follow"]), np.uint32).reshape(-1, MATCH_AHEAD)
        match, came = match_of(tree, tops, t.symbols, hashes[t.numbers], first, ~group["held_out"].to_numpy(bool), (told["context"].to_numpy(), follow, told["c"].to_numpy()))
        score_ = add(rare_with_match(tail[t.numbers], is_rare[t.numbers], match, came, first)) + mix_texts(tree, t, first, table, match)
        size_ = np.array([len(x.encode("utf-8", "surrogatepass")) if x else 0 for x in texts]) + 1
        return pd.DataFrame({"doc_id": pd.array(group["doc_id"], dtype="Int64"), "held_out": group["held_out"].to_numpy(), "n_tokens": tokens, "n_known": known_, "train_tokens": n_train, "base_score": base_, "score": score_, "bits_per_byte": -score_ * np.log2(10) / size_})

    return rows.groupBy("chunk").cogroup(returned.groupBy("chunk")).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def read(texts: list[str | None], tree: Tree, number: Callable[[bytes], int], symbols: np.ndarray | None = None) -> tuple[Tokens, np.ndarray]:
    """(tokens, first token of each text and the end). number gives a token's symbol, or its number in a vocabulary whose symbols are given."""
    lists = [np.fromiter(map(number, tokens_of(x)), np.int64) for x in texts]
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    first = np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)].astype(np.int64)
    starts = np.zeros(len(flat), bool)
    starts[first[:-1]] = True
    return Tokens.of(tree, flat if symbols is None else symbols[flat], starts, flat), first
