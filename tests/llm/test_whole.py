"""Cases in which operators once did less than the whole job."""

import math
import os
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestrata.llm import common, jaccard, langid, lm_scoring, mixing, simhash, toxicity
from lodestrata.llm.common import among, prefix_sums

from .test_operators import SYLLABLES, crf, prose, table  # noqa: F401


# --- pipeline: near-dedup


def test_rows_without_id_or_with_a_shared_id_stand_for_themselves(spark):
    rng = random.Random(21)
    a, b, c, d, e = (prose("en", 80, rng) for _ in range(5))
    docs = table(spark, [a, b, c, c, d, a, e, d], [None, None, None, None, 4, 4, 4, 2])
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    want = [(2, d), (4, a), (4, e), (None, b), (None, c)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_near_copies_with_edited_words_go(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROWS", 8)
    rng = random.Random(23)
    texts = []
    for n in (8, 20, 60, 150, 150, 150, 400):
        base = prose("en", n, rng).split()
        for edits in (0, 1, 2, n // 60, n // 40, n // 20):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n)] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    line = prose("de", 12, rng)
    texts += [f"{prose('fr', 20, rng)} {line} {prose('fr', 20, rng)}" for _ in range(30)] + ["", None, "one two"]
    docs = table(spark, texts)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    stage = dict(P.STAGES)["near-dedup"]
    kept = {r.doc_id for r in stage(spark, docs.select(P.COLUMNS), "").collect()}
    root = list(range(len(texts)))
    prints = [simhash.fingerprint(t) for t in texts]
    first = {i: min(j for j in range(len(texts)) if ((prints[i] ^ prints[j]) % 2**64).bit_count() <= 3) for i in root}
    assert len([p for p in alike if first[p[0]] != first[p[1]]]) > 10  # fingerprints alone keep both
    assert not [p for p in alike if set(p) <= kept]
    reach = {i: {i} for i in root}
    for i, j in [*alike, *first.items()]:
        both = reach[i] | reach[j]
        for k in both:
            reach[k] = both
    assert kept == {min(g) for g in reach.values()}


def test_counts_rule_out_no_similar_pair():
    rng = np.random.default_rng(29)
    sets = []
    for n in (1, 3, 9, 40, 300, 3000, 90_000):
        base = rng.integers(0, 2**64, n, np.uint64)
        for part in (0, 0.03, 0.1, 0.12, 0.5, 1):
            new = base.copy()
            new[rng.permutation(n)[: int(part * n)]] = rng.integers(0, 2**64, int(part * n), np.uint64)
            sets.append(np.unique(new))
    n = np.array([len(s) for s in sets])
    alike = [(i, j) for j in range(len(sets)) for i in range(j) for both in [len(np.intersect1d(sets[i], sets[j]))] if 100 * both >= 80 * (n[i] + n[j] - both)]
    may = lambda i, j: bool(jaccard.linked([jaccard.group_counts(sets[k])[0] for k in (i, j)], n[[i, j]], np.zeros(2, np.int64), 80))
    assert len(alike) > 25 and all(may(i, j) for i, j in alike)
    assert not any(may(i, i + 5) for i in range(18, len(sets), 6))  # unrelated, of one size
    assert not jaccard.linked([jaccard.group_counts(sets[-6])[0]] * 2, n[[-6, -6]], np.zeros(2, np.int64), 80, label=np.zeros(2, np.int64))  # linked already


# --- pipeline: language ID


def test_switched_text_has_a_language(spark, crf):  # noqa: F811
    rng = random.Random(22)
    texts = [" ".join(prose(lang, 40, rng) for lang in SYLLABLES) for _ in range(20)] + ["12 34", None]
    _, scores = langid.judge(texts, crf, {})
    assert (scores < 0.5).all()  # in three languages none has half of the words
    assert sorted(r.doc_id for r in langid.keep_known(table(spark, texts), crf).collect()) == list(range(20))

# --- 6


def test_second_persons_are_near_in_long_texts_too():
    model = toxicity.Model({"scum": 3})
    near = [model.features("you scum " * n + "word " * 50)[8:10] for n in (900, 1100)]
    assert near == [[900.0, 1.0], [1100.0, 1.0]]
    rng = np.random.default_rng(7)
    for _ in range(50):
        at, to = (np.sort(rng.choice(200, rng.integers(1, 40), replace=False)) for _ in range(2))
        assert np.array_equal(toxicity.gaps(at.tolist(), to.tolist()), np.abs(np.subtract.outer(at, to)).min(1))


def test_parts_of_a_small_sample_each_have_both_labels(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "lexicon", lambda texts, y: seen.append((set(texts), set(y.tolist()))) or {})
    monkeypatch.setattr(toxicity, "boost", lambda model, x, y: seen.append((None, set(y.tolist()))))
    monkeypatch.setattr(toxicity, "isotonic", lambda m, y: seen.append((None, set(y.tolist()))) or (np.zeros(1), np.zeros(1)))
    for bad in (1, 2, 3, 4, 50):
        seen.clear()
        assert toxicity.train([(f"fine {i}", 0) for i in range(40)] + [(f"bad {i}", 1) for i in range(bad)])
        assert [s[1] for s in seen] == [{0, 1}] * 3 and len([t for t in seen[0][0] if t.startswith("bad")]) == (bad if bad < 3 else max(1, min(bad - 2, round(bad * toxicity.PARTS[0]))))


# --- 1, 2


def test_rows_with_equal_keys_are_parted_and_reruns_agree(spark):
    rng = random.Random(31)
    texts = [prose("en", rng.randint(100, 400), rng) for _ in range(40)]
    docs = table(spark, ["a b c d " * 40] * 400 + texts * 2, [None] * 400 + [5] * 80)
    own = prefix_sums(docs.select("doc_id", F.length("text").cast("long").alias("v")), ["doc_id"], "v")[0]
    assert own.rdd.getNumPartitions() > 0 and own.count() == 480
    parts = [r.n for r in own.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(parts) < 300
    once, again = (sorted(((r._c_text or "", r._taken) for r in mixing.taken(mixing.mix(docs.repartition(n), ["text"])).collect()), key=str) for n in (3, 7))
    assert [x for x in once if x[0] in texts] == [x for x in again if x[0] in texts]


# --- 5


def test_a_large_shard_goes_on_by_a_tree_of_its_own(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**32, 300, dtype=np.uint64)
    fps = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(3))]).view(np.int64)
    u, v = simhash.shard_edges(fps, 0xFFFFFFFF, 3)

    def roots(a, b):
        root = {x: x for x in np.unique(fps).tolist()}
        def top(x):
            while root[x] != x:
                x = root[x]
            return x
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = top(x), top(y)
            root[max(x, y)] = min(x, y)
        return {x: top(x) for x in root}

    # the other half's tree brings the rest; pairs that differ in at most one low bit must be in the same component
    mine = roots(u, v)
    w = np.unique(fps).view(np.uint64)
    near = (np.bitwise_count(w[:, None] ^ w[None]) <= 3) & (np.bitwise_count((w[:, None] ^ w[None]) & np.uint64(0xFFFFFFFF)) <= 1)
    for i, j in zip(*np.nonzero(near), strict=True):
        assert mine[int(w[i].view(np.int64))] == mine[int(w[j].view(np.int64))]


def test_the_pipelines_tables_go(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:") + "/lodestrata"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    P.run(spark, "/root/testdata/sf0.001").count()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert {n for n in left if n.startswith("pipeline-")} == {"pipeline-3"}


# --- 3


def plain_mix(tree, symbols, one, two, match, table):
    """The mixer decision by decision, for one text: the same updates after the same steps."""
    M, size = lm_scoring, len(table) // 2
    w, own, refine = np.tile(np.array(M.START, np.float32), (M.GATES, 1)), {}, [min(0.995, max(0.005, i / M.BINS)) for i in range(M.BINS + 1)]
    total, at, step = 0.0, 0, 0
    while at < len(symbols):
        wide = M.STEPS[min(step, len(M.STEPS) - 1)]
        moves, adds, bins = {}, [], {}
        for i in range(at, min(at + wide, len(symbols))):
            path = range(tree.first[symbols[i]], tree.first[symbols[i] + 1])
            told = list(range(tree.first[match.symbols[i]], tree.first[match.symbols[i] + 1]))
            for k, e in enumerate(path):
                node, bit = int(tree.nodes[e]), int(tree.bits[e])
                slots = []
                for h in (one[i], two[i]):
                    h = ((int(h) ^ (node * 0xD6E8FEB86659FD93 % 2**64)) * 0x9E3779B97F4A7C15) % 2**64
                    slots.append(h >> (64 - size.bit_length() + 1))
                on = match.state[i] > 0 and k < len(told) and tree.nodes[told[k]] == node
                state = int(match.state[i]) if on else 0
                mine = math.log((own.get((node % M.LOCAL, 1), 0) + 0.4) / (own.get((node % M.LOCAL, 0), 0) + 0.4))
                x = np.array([tree.prior[node], table[slots[0]], table[size + slots[1]], mine, M.MATCH_SAYS[state] * (2 * int(tree.bits[told[k]]) - 1) if on else 0.0])
                gate = int(tree.depth[e]) * M.MATCHES + state
                p = 1 / (1 + math.exp(-float(np.clip(w[gate] @ x, -14, 14))))
                b = int(p * M.BINS + 0.5)
                f = min(1 - 1e-6, max(1e-6, 0.7 * p + 0.3 * refine[b]))
                total += math.log10(f if bit else 1 - f)
                moves.setdefault(gate, []).append((bit - p) * x)
                adds.append((node % M.LOCAL, bit))
                bins.setdefault(b, []).append(bit)
        for gate, m in moves.items():
            w[gate] += M.RATE / max(1, len(m) / 16) * np.sum(m, 0)
        for key in adds:
            own[key] = own.get(key, 0) + 1
        for b, ys in bins.items():
            refine[b] += (1 - (1 - M.REFINE_RATE) ** len(ys)) * (sum(ys) / len(ys) - refine[b])
        at, step = at + wide, step + 1
    return total


def test_mixing_is_the_plain_one_through_whole_texts():
    rng = np.random.default_rng(3)
    words = [b"w%d" % i for i in range(40)]
    tree = lm_scoring.Tree.over(words, sorted(rng.integers(2, 500, 40).tolist(), reverse=True), 100)
    symbols = [rng.integers(0, 41, n) for n in (1, 3, 200, 900)]
    first = np.r_[0, np.cumsum([len(s) for s in symbols])]
    starts = np.zeros(first[-1], bool)
    starts[first[:-1]] = True
    t = lm_scoring.Tokens.of(tree, np.concatenate(symbols), starts, np.concatenate(symbols))
    table = rng.normal(0, 0.5, 2 * 1024).astype(np.float32)
    state = rng.integers(0, 3, first[-1]).astype(np.int8)
    match = lm_scoring.Match(np.where(rng.random(first[-1]) < 0.7, t.symbols, 0).astype(np.int64), state)
    got = lm_scoring.mix_texts(tree, t, first, table, match)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        own = lm_scoring.Match(match.symbols[a:b], match.state[a:b])
        assert math.isclose(got[i], plain_mix(tree, t.symbols[a:b], t.before[0][a:b], t.before[1][a:b], own, table), rel_tol=2e-4)


def test_all_symbols_together_have_probability_one():
    words = [b"w%d" % i for i in range(12)]
    tree = lm_scoring.Tree.over(words, list(range(40, 28, -1)), 9)
    table = np.random.default_rng(1).normal(0, 1, 2 * 1024).astype(np.float32)
    before = np.array([3, 5, 7])
    total = 0.0
    for s in range(13):
        text = np.r_[before, s]
        t = lm_scoring.Tokens.of(tree, text, np.array([True, False, False, False]), text)
        both = [lm_scoring.mix_texts(tree, lm_scoring.Tokens.of(tree, x, np.arange(len(x)) == 0, x), np.array([0, len(x)]), table)[0] for x in (before, text)]
        total += 10 ** (both[1] - both[0])
        assert len(t.n) == 4
    assert math.isclose(total, 1, rel_tol=1e-3)


@pytest.mark.parametrize(("state", "told"), [(1, 4), (2, 0), (1, 12), (2, 7)])
def test_all_symbols_together_have_probability_one_with_a_match(state, told):
    """What is foretold is known before the token: with the same match for all that may come, probabilities sum to one, rarer tokens included."""
    words = [b"w%d" % i for i in range(12)]
    tree = lm_scoring.Tree.over(words, list(range(40, 28, -1)), 9)
    table = np.random.default_rng(1).normal(0, 1, 2 * 1024).astype(np.float32)
    before, total = np.array([3, 5, 7]), 0.0
    for s in range(13):
        text = np.r_[before, s]
        t = lm_scoring.Tokens.of(tree, text, np.array([True, False, False, False]), text)
        match = lm_scoring.Match(np.array([0, 0, 0, told]), np.array([0, 0, 0, state], np.int8))
        both = [lm_scoring.mix_texts(tree, lm_scoring.Tokens.of(tree, x, np.arange(len(x)) == 0, x), np.array([0, len(x)]), table, lm_scoring.Match(match.symbols[: len(x)], match.state[: len(x)]))[0] for x in (before, text)]
        total += 10 ** (both[1] - both[0])
    assert math.isclose(total, 1, rel_tol=1e-3)
    tail = np.log10(np.array([0.5, 0.3, 0.2]))  # three rarer tokens share a leaf; a foretold one takes its part from all
    rare = [lm_scoring.rare_with_match(tail[[k]], np.array([True]), lm_scoring.Match(np.array([0]), np.array([state], np.int8)), np.array([k == 1]), np.array([0, 1]))[0] for k in range(3)]
    assert math.isclose(sum(10**x for x in rare), 1, rel_tol=1e-9)


def test_held_out_scores_depend_on_no_held_out_row(spark):
    """Rows that are held out change nothing for each other: copies of training texts, of each other, and texts that go on otherwise."""
    rng = random.Random(17)
    fresh = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(40, 200))) for _ in range(60)]
    other = [" ".join([*fresh[i].split()[:60], *(f"w{rng.randrange(300)}" for _ in range(40))]) for i in range(20)]
    held = [*other, *fresh[:10], " ".join(f"w{rng.randrange(300)}" for _ in range(90))]
    score = lambda more: {r.doc_id: r.score for r in lm_scoring.score_documents(table(spark, [*fresh, *more]), F.col("doc_id") >= len(fresh)).collect()}
    all_of_them = score(held)
    for k in (0, 25, len(held) - 1):
        alone = score([None] * k + [held[k]])
        assert math.isclose(alone[len(fresh) + k], all_of_them[len(fresh) + k], rel_tol=1e-5)
    assert all(math.isclose(alone[i], all_of_them[i], rel_tol=1e-5) for i in range(len(fresh)))


def test_matches_tell_copies_apart_and_grow_with_the_corpus(spark):
    rng = random.Random(41)
    fresh = [" ".join(f"w{rng.randrange(4000)}" for _ in range(300)) for _ in range(120)]
    texts = [x for i, x in enumerate(fresh)] + fresh[:20]  # the last twenty stand in the corpus already
    docs = table(spark, texts)
    out = {r.doc_id: r for r in lm_scoring.score_documents(docs, F.col("doc_id") >= 100).collect()}
    copies, others = [out[i].score for i in range(120, 140)], [out[i].score for i in range(100, 120)]
    assert max(others) < 0.8 * min(copies) < 0  # all copies are far likelier than all others
    assert [lm_scoring.frequent(n) for n in (0, 10**6, 10**9, 10**12)] == [4095, 4095, 18973, 65535]
    assert [lm_scoring.slot_count(n) for n in (0, 10**8, 10**10)] == [1 << 20, 1 << 21, 1 << 23]


def test_chunks_part_copies(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 2000)
    docs = table(spark, ["the same words in every text " * 10] * 60, [None] * 60)
    out = lm_scoring.score_documents(docs, F.lit(False)).collect()
    assert len(out) == 60 and len({round(r.score, 6) for r in out}) == 1


def test_spelling_weights_are_fitted_on_all_rarer_tokens(spark, monkeypatch):
    """Where the fit begins, and on how few tokens, doesn't show in its result."""
    rng, syllables = random.Random(23), [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + (str(rng.randrange(50)) if rng.random() < 0.3 else "") for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(60)]
    monkeypatch.setattr(lm_scoring, "frequent", lambda tokens: 20)
    monkeypatch.setattr(lm_scoring, "SETTLED", 1e-9)
    fits, real = [], lm_scoring.fitted_weights
    monkeypatch.setattr(lm_scoring, "fitted_weights", lambda rare, counts, weights: fits.append((sorted(bytes(r.token) for r in rare.collect()), counts, real(rare, counts, weights))) or fits[-1][2])
    scores = []
    for n in (3, 6000):
        monkeypatch.setattr(lm_scoring, "WORDS", n)
        scores.append({r.doc_id: r.score for r in lm_scoring.score_documents(table(spark, texts), F.col("doc_id") >= 50).collect()})
    assert all(math.isclose(scores[0][i], scores[1][i], rel_tol=1e-4) for i in scores[0])
    for rare, counts, fitted in fits:
        assert len(rare) > 1000
        assert np.allclose(fitted, lm_scoring.spelling_weights(rare, counts, 30), atol=5e-3)


@pytest.mark.parametrize("words", [1 << 20, 0])
def test_rows_among_some_numbers_stay_where_they_are(spark, monkeypatch, words):
    monkeypatch.setattr(common, "MOST_WORDS", words)
    rows = simhash.numbered(spark.range(0, 5000, 1, 7).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")))
    some = rows.where("c_doc_id % 64 in (0, 63) or c_doc_id % 7 = 3").select("_rid")
    got = among(rows, some)
    assert sorted(r.c_doc_id for r in got.collect()) == [i for i in range(5000) if i % 64 in (0, 63) or i % 7 == 3]
    assert got.columns == rows.columns and among(rows, some.where("false")).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the numbers are too many for Spark's own choice
    try:
        plan = among(rows, some)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("SortMergeJoin" in plan) == (words == 0)


def test_op3_driver_holds_packed_tables_once(spark, monkeypatch):
    """op3, driver's memory: tables come to the driver packed in 32 bits, stretched by the tasks if that is all that is asked, and the fit's passes send the spelling's counts once."""
    M, size = lm_scoring, len(lm_scoring.ORDERS) * lm_scoring.SPELL_SLOTS
    rng = np.random.default_rng(3)
    counts = np.zeros(2 * size, np.int64)
    counts[: 3 * M.BLOCK] = rng.integers(0, 5, 3 * M.BLOCK)
    counts[0] = 2**32 - 1
    rows = [(b["block"], b["n"]) for batch in M.count_blocks(counts) for b in batch.to_pylist()]
    parts = spark.createDataFrame([*rows, rows[1]], "block int, n binary")
    counts[M.BLOCK : 2 * M.BLOCK] *= 2
    tracemalloc.start()
    got = M.gathered(parts, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and (got.ravel() == np.minimum(counts, 2**31 - 1)).all()
    assert (M.gathered(parts, size, stretched=True) == M.counted(counts.reshape(-1, 2))).all()
    for bit in (0, 1):
        less = got.astype(np.float32)
        less[:, bit] -= 1
        assert (M.spelling_left(got)[:, bit] == M.counted(np.maximum(less, 0))).all()
    sent, plain = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(getattr(value, "nbytes", None) or len(value)) or plain(self, value))
    monkeypatch.setattr(M, "PASSES", 3)
    monkeypatch.setattr(M, "SETTLED", -1e9)
    start = M.spelling_weights([], got)
    fitted = M.fitted_weights(spark.createDataFrame([(bytearray(b"ab"),), (bytearray(b"cd"),)], "token binary"), got, start)
    assert np.allclose(fitted, M.spelling_weights([b"ab", b"cd"], got, 3), atol=1e-5)
    assert sum(n > 10 << 20 for n in sent) == 1
