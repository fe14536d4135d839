"""Each operator against a plain version of itself, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import ann, decontam, langid, line_dedup, lm_scoring, mixing, sharding, simhash, toxicity, url_filter
from lodestrata.llm.common import prefix_sums

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\f\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, slot long, fp long, _id long, score double, _text string"
RNG = random.Random(11)
SYLLABLES = {"en": "the an er on re ti es or te of ed".split(), "de": "sch ein ung keit ver ich der zu".split(), "fr": "eau oi ez que les ment ai ou".split()}


def prose(lang, n, rng=RNG):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def table(spark, texts, ids=None, langs=None, sources=None):
    """documents with columns that the operators might use for themselves."""
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", None, 7, 8, 9, 10, 11, 1.5, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = ["", None, " \t\n", "one", "One two\nthree\n\nfour", "a\x85b c\u2003d", "x " * 30_000, "the same text here", "the same text here", "ÄÖÜ straße 中文 \U0001f600", "line one is here\nline two is here"]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [*ODD, "null id", "the same text here"], [*range(len(ODD)), None, 7])


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, []).where("false")


def test_prefix_sums(spark):
    rows = [(RNG.randint(0, 3), i, RNG.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, id long, v long")
    out, totals = prefix_sums(df, ["id"], "v", "g")
    got = {(r.g, r.id): (r._before, r._index) for r in out.collect()}
    for g in range(4):
        own = sorted(r for r in rows if r[0] == g)
        for i, r in enumerate(own):
            assert got[g, r[1]] == (sum(x[2] for x in own[:i]), i)
        assert totals[g] == (sum(x[2] for x in own), len(own))


# --- 1


def test_sharding_is_balanced_and_contiguous(spark):
    texts = ["same words again"] * 150 + [prose("en", RNG.randint(1, 200)) for _ in range(300)]
    rows = sharding.shard_by_bytes(table(spark, texts), 10).collect()
    size = {i: len(t.encode()) + 16 for i, t in enumerate(texts)}
    assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and all(r["size"] == size[r.doc_id] for r in rows)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    per, slots = Counter(), defaultdict(list)
    for r in rows:
        per[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(per) == set(range(10)) and max(per.values()) - min(per.values()) <= 2 * max(size.values()) + sum(size.values()) // 500
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(rows, key=lambda r: (r.text_crc32, r.doc_id))
    assert [r.shard for r in order] == sorted(r.shard for r in rows)


def test_sharding_odd_rows(odd, empty):
    rows = sharding.shard_by_bytes(odd, 3).collect()
    assert len(rows) == len(ODD) + 2 and {r["size"] for r in rows if r.doc_id in (0, 1)} == {16}
    assert sharding.shard_by_bytes(empty).count() == 0
    assert {r.shard for r in sharding.shard_by_bytes(odd.limit(1), 5).collect()} <= set(range(5))


# --- 2


def test_targets_meet_their_caps():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 100, 10_000]) * rng.randint(1, 9) for _ in range(rng.randint(1, 9))]
        t = mixing.targets(sizes)
        assert math.isclose(sum(t), sum(sizes), abs_tol=1e-6) and all(x <= 3 * s + 1e-6 for x, s in zip(t, sizes, strict=True))
        open_ = [(x / (5, 2, 1)[i % 3]) for i, (x, s) in enumerate(zip(t, sizes, strict=True)) if x < 3 * s - 1e-6]
        assert not open_ or max(open_) - min(open_) < 1e-6


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        p = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(p.tolist()) == list(range(n))
    assert mixing.shard_counts([5, 0, 90], 7, 1).sum(0).tolist() == [5, 0, 90]


def test_mixing_follows_its_plan(spark):
    sources = [RNG.choice(["a", "b", None, "hot", "hot", "hot"]) for _ in range(400)]
    texts = [prose("en", RNG.randint(0, 400)) for _ in range(400)]
    docs = table(spark, texts, sources=sources)
    m = mixing.mix(docs, ["doc_id"], block=32)
    rows = mixing.taken(m).collect()
    n = {i: len(WORD.findall(t)) for i, t in enumerate(texts)}
    assert {r._c_doc_id: r._size for r in rows} == n and all(r._taken <= 3 * r._size for r in rows)
    for s in m.plan:
        own = [r for r in rows if r._code == s.code]
        assert sum(r._size for r in own) == s.size and abs(sum(r._taken for r in own) - s.target) <= 32
    assert [s.name for s in m.plan] == ["a", "b", "hot", None]
    again = {r._c_doc_id: r._taken for r in mixing.taken(mixing.mix(docs.repartition(7), ["doc_id"], block=32)).collect()}
    assert again == {r._c_doc_id: r._taken for r in rows}
    out = mixing.mixed_documents(docs, block=32).collect()
    words = Counter()
    for r in out:
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert {k: v for k, v in words.items() if v} == {r._c_doc_id: r._taken for r in rows if r._taken}
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_mixing_odd_rows(odd, empty):
    m = mixing.mix(odd, ["doc_id"])
    assert m.rows.count() == len(ODD) + 2 and mixing.taken(mixing.mix(empty, ["doc_id"])).count() == 0
    assert mixing.mixed_documents(empty).count() == 0 and mixing.mixed_documents(odd).count() >= len(ODD)


# --- 3


def plain_base(texts, held):
    c = Counter(t for x, h in zip(texts, held, strict=True) if not h for t in lm_scoring.tokens_of(x))
    n, v = sum(c.values()), len(c)
    return n, [(len(lm_scoring.tokens_of(x)), sum(c[t] > 0 for t in lm_scoring.tokens_of(x)), sum(math.log10((c[t] + 1) / (n + v + 1)) for t in lm_scoring.tokens_of(x))) for x in texts]


def test_lm_counts_and_base_are_plain_and_model_beats_base(spark):
    rng = random.Random(5)
    texts = [prose(rng.choice(["en", "de", "fr"]), rng.randint(1, 120), rng) for _ in range(600)] + ["", None]
    held = [i % 7 == 2 for i in range(len(texts))]
    out = {r.doc_id: r for r in lm_scoring.score_documents(table(spark, texts), F.col("doc_id") % 7 == 2).collect()}
    n, plain = plain_base(texts, held)
    for i, (a, b, c) in enumerate(plain):
        r = out[i]
        assert (r.train_tokens, r.n_tokens, r.n_known, r.held_out) == (n, a, b, held[i]) and math.isclose(r.base_score, c, rel_tol=1e-9)
        assert r.score <= 0 and math.isclose(r.bits_per_byte, -r.score * math.log2(10) / (len((texts[i] or "").encode()) + 1), rel_tol=1e-9)
    test = [i for i in out if held[i]]
    assert sum(out[i].score for i in test) > sum(out[i].base_score for i in test)


def test_lm_codes_are_probabilities():
    words = [b"a", b"b", lm_scoring.END, b"cc"]
    tree = lm_scoring.Tree.over(words, [50, 20, 10, 5], 15)
    lengths = np.diff(tree.first)
    assert math.isclose(sum(2.0 ** -int(x) for x in lengths), 1.0)
    table_ = np.zeros(len(lm_scoring.ORDERS) * lm_scoring.SPELL_SLOTS, np.float32)
    assert np.allclose(lm_scoring.spell([b"ab", b""], table_, lm_scoring.spelling_weights([], np.zeros((1, 2)))), [-24 * math.log10(2), -8 * math.log10(2)])


def test_lm_odd_rows(odd, empty):
    rows = lm_scoring.score_documents(odd, F.lit(False)).collect()
    assert len(rows) == len(ODD) + 2 and {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1} and all(math.isfinite(r.score) for r in rows)
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm_scoring.score_documents(odd, F.lit(True)).collect())
    assert lm_scoring.score_documents(empty, F.lit(False)).count() == 0


# --- 4


def plain_lines(rows):
    keys = defaultdict(set)
    key = lambda s: s.strip(SPACE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    big = 2**63
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                keys[key(x)].add(big if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(keys.get(key(x), ())) > 1 and (big if d is None else d) > min(keys[key(x)]))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark):
    pool = ["Common line number one", "  common LINE number one\t", "short", "another frequent line", "ÄNOTHER frequent line", "änother frequent line", "", "tenletters", "nineletrs"]
    rows = [(RNG.choice([None, *range(60)]), "\n".join(RNG.choice([*pool, prose("en", 4)]) for _ in range(RNG.randint(0, 150)))) for _ in range(120)] + [(3, None), (5, ""), (6, "Common line number one\n" * 200), (6, "x\nCommon line number one")]
    docs = table(spark, [t for _, t in rows], [d for d, _ in rows])
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("h"))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, plain_lines(rows)))


def test_line_dedup_streams_the_sorted_partitions(spark, monkeypatch):
    """One range exchange of the lines, sorted by hash, document and position, which the window reads; frequent lines go by partial sums."""
    monkeypatch.setattr(line_dedup, "FREQUENT", 20)
    rows = [(i, f"a line in every text\n{prose('en', 6)}\nshared by some {i % 7}\n{'a line in every text' if i % 3 else 'x'}") for i in range(200)]
    docs = table(spark, [t for _, t in rows], [d for d, _ in rows])
    drops = line_dedup.keep_bitmaps(docs)
    plan = drops._jdf.queryExecution().sparkPlan().toString() + drops._jdf.queryExecution().executedPlan().toString()
    executed = drops._jdf.queryExecution().executedPlan().toString()
    assert executed.count("rangepartitioning(_h") == 1 and "Sort [_h" in executed and "Window" in plan
    order = re.search(r"Sort \[_h#\d+L? ASC NULLS FIRST, _g#\d+L? ASC NULLS FIRST, _id#\d+L? ASC NULLS FIRST, _pos#\d+ ASC NULLS FIRST\], false", executed)
    assert order and "SortMergeJoin" not in executed
    out = line_dedup.apply_bitmaps(docs, drops).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("h"))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, plain_lines(rows)))


def test_line_dedup_odd_rows(odd, empty):
    assert line_dedup.apply_bitmaps(odd, line_dedup.keep_bitmaps(odd)).count() == len(ODD) + 2
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).count() == 0


# --- 5


def plain_print(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)] or ([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [])
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_simhash_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "TASK_LEAF", 64)
    base = [prose("en", 300) for _ in range(60)]
    texts = base + [b.replace(b.split()[7], "changed", 1) for b in base[:30]] + base[:10] + ["", None, " ", "a", "A"]
    for k in range(40):  # a chain of near copies
        w = base[0].split()
        w[k] = f"w{k}"
        texts.append(" ".join(w))
    out = {r.doc_id: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    prints = [plain_print(t) for t in texts]
    assert [out[i].fp % 2**64 for i in range(len(texts))] == prints
    assert [out[i].component_id for i in range(len(texts))] == plain_components(prints)


def test_vantage_trees_lose_no_pair(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 200, dtype=np.uint64)
    points = np.unique(np.concatenate([centres, *[centres ^ (np.uint64(1) << np.uint64(b)) for b in rng.integers(0, 64, 6)], *[centres ^ np.uint64(int(m)) for m in (7, 1 << 40 | 1 << 3 | 1 << 63, 0b11 << 30)]]))
    trees = [simhash.Tree(m, 1).grow(points, 7, s) for s, m in enumerate((0xFFFFFFFF, 0xFFFFFFFF << 32))]
    assert all(len(t.cut) > 20 for t in trees)
    met = set()
    for t in trees:
        leaf, at = t.route(points)
        by = defaultdict(list)
        for a, b in zip(leaf.tolist(), at.tolist(), strict=True):
            by[a].append(b)
        for own in by.values():
            d = np.bitwise_count(points[own][:, None] ^ points[own][None]) <= 3
            met |= {(own[i], own[j]) for i, j in zip(*np.nonzero(np.triu(d, 1)), strict=True)} | {(own[j], own[i]) for i, j in zip(*np.nonzero(np.triu(d, 1)), strict=True)}
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 3
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if i != j} == {(int(i), int(j)) for i, j in met}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 500: 500, 501: 500}


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) + 2 and {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0} and {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each_group(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and sorted(ids, key=str) == sorted([0, 3, 4, 5, 6, 7, 9, 10, None], key=str)


# --- 6


def toxic_rows(n, rng):
    out = []
    for _ in range(n):
        y = rng.random() < 0.3
        w = prose(rng.choice(["en", "de"]), rng.randint(8, 60), rng).split()
        if y:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "Moron"]))
        out.append((" ".join(w), int(y if rng.random() > 0.05 else not y)))
    return out


def test_toxicity_on_held_out_rows():
    rng = random.Random(1)
    model = toxicity.train(toxic_rows(1500, rng))
    assert {"idiot", "scum", "moron"} <= {w for w, t in model.lexicon.items() if t > 0}
    test = toxic_rows(400, rng)
    s, y = model.scores([t for t, _ in test]), np.array([v for _, v in test])
    assert ((s >= 0.5) == y).mean() > 0.9 and s.min() >= 0 and s.max() <= 1
    again = toxicity.train(list(reversed(toxic_rows(1500, random.Random(1)))))
    assert np.array_equal(again.scores([t for t, _ in test]), s)


def test_copies_put_no_words_into_the_lexicon():
    rng = random.Random(3)
    copied = "zyx wvu tsr copied passage"
    rows = toxic_rows(800, rng) + [(copied + f" {i}", 1) for i in range(200)]
    words = toxicity.lexicon([t for t, _ in rows], np.array([y for _, y in rows]))
    assert "wvu" not in words and "idiot" in words


def test_isotonic():
    x, y = np.arange(8.0), np.array([0, 0, 1, 0, 1, 1, 0, 1])
    knots, p = toxicity.isotonic(x, y)
    assert (np.diff(knots) > 0).all() and (np.diff(p) >= 0).all() and p[0] == 0 and p[-1] == 1


def test_toxicity_odd_rows(spark, odd, empty):
    model = toxicity.train(toxic_rows(300, random.Random(1)))
    rows = toxicity.score_documents(odd, model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(empty, model).count() == 0 and {r.score for r in toxicity.score_documents(odd, None).collect()} == {0.0}
    assert toxicity.train([]) is None and toxicity.train([("a", 1)]) is None and toxicity.train([("a", 1), ("b", 0)]) is not None
    labels = spark.createDataFrame([(4, 1), (4, 0), (99, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.sample(odd, labels) == [(ODD[4], 1)]


# --- 7


def brute_posteriors(crf, scores):
    """By summing over all label sequences."""
    n, k = scores.shape
    total = np.zeros((n, k))
    for path in np.ndindex(*[k] * n):
        p = crf.start[path[0]] + sum(scores[i, c] for i, c in enumerate(path)) + sum(crf.transitions[a, b] for a, b in zip(path, path[1:], strict=False))
        for i, c in enumerate(path):
            total[i, c] += math.exp(p)
    return total / total.sum(1, keepdims=True)


@pytest.fixture(scope="module")
def crf():
    rng = random.Random(8)
    return langid.train([(lang, prose(lang, 60, rng)) for lang in SYLLABLES for _ in range(60)])


def test_forward_backward_is_exact(crf):
    rng = np.random.default_rng(1)
    scores = [rng.normal(size=(n, 3)) * 2 for n in (1, 4, 6, 2)]
    for got, s in zip(crf.posteriors(scores), scores, strict=True):
        assert np.allclose(got, brute_posteriors(crf, s), atol=1e-9)


def test_language_of_held_out_and_switched_text(crf):
    rng = random.Random(9)
    test = [(lang, prose(lang, 25, rng)) for lang in SYLLABLES for _ in range(40)]
    langs, scores = langid.judge([t for _, t in test], crf, {})
    assert np.mean([a == b for a, (b, _) in zip(langs, test, strict=True)]) > 0.97 and (scores <= 1).all()
    words = langid.letter_runs(prose("en", 20, rng) + " " + prose("de", 20, rng))
    p = crf.posteriors([crf.emissions(words)])[0].argmax(1)
    assert (p[:15] == crf.langs.index("en")).mean() > 0.8 and (p[-15:] == crf.langs.index("de")).mean() > 0.8


def test_language_odd_rows(spark, odd, empty, crf):
    rows = langid.label_documents(odd, crf).collect()
    assert len(rows) == len(ODD) + 2 and {(r.lang_pred, r.score) for r in rows if r.doc_id in (0, 1, 2)} == {("und", 0.0)}
    nothing = table(spark, ["123 !? ²", "..."])
    assert {r.lang_pred for r in langid.label_documents(nothing, crf).collect()} == {"und"}
    assert langid.label_documents(empty, crf).count() == 0 and {r.lang_pred for r in langid.label_documents(odd, None).collect()} == {"und"}
    kept = langid.keep_known(odd, crf)
    assert kept.columns == odd.columns and not {0, 1, 2} & {r.doc_id for r in kept.collect()}
    assert langid.sample(empty) == [] and langid.train([]) is None and langid.train([("en", "12")]) is None
    assert len(langid.sample(table(spark, ["a", None, "b"], langs=["en", "en", None]))) == 1


# --- 8


def plain_verdict(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else "allow"


def test_url_filter(spark, monkeypatch):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "", "block"), ("a.org", "/x", "allow")]
    urls = [None, "", "nothing", "http://net/", "https://X.Example.NET/en/a?b#c", "http://example.net/en", "http://notexample.com/de/", "http://example.com/de/x", "http://example.com:80/de/", "ftp://b.a.org/x/y", "http://a.org", "http://a.org?x", "http://é.org/fr/ü", "x://y://z.net/", "http://..net/"] + [f"http://h{i % 5}.net/{'p/' * (i % 4)}" for i in range(50)]
    pages = spark.createDataFrame([(i if i % 9 else None, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    r = spark.createDataFrame([*rules, (None, "/", "block"), rules[0]], "host string, path string, verdict string")
    for limit in (url_filter.BROADCAST_RULES, -1):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
        out = url_filter.filter_urls(pages, r).collect()
        assert sorted(map(repr, [(x.host, x.path, x.rule, x.verdict) for x in out])) == sorted(map(repr, [plain_verdict(u, rules) for u in urls]))
    assert url_filter.filter_urls(pages.where("false"), r).count() == 0 and {x.verdict for x in url_filter.filter_urls(pages, r.where("false"), "block").collect()} == {"block"}


# --- 9


def plain_distance(a, b):
    """Of a to the best part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distance_is_plain():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        d, lo, hi = decontam.best_match(np.array(a), np.array(b))
        assert d == plain_distance(a, b) and 0 <= lo <= hi <= len(b) and plain_distance(a, b[lo:hi]) == d


def test_contamination_is_found_up_to_a_fifth_of_edits(spark):
    rng = random.Random(12)
    items = [prose("en", rng.randint(14, 60), rng) for _ in range(60)]
    texts, want = [], {}
    for k in range(300):
        w = items[k % 60].split()
        for _ in range(int(len(w) * rng.choice([0, 0.05, 0.1, 0.2]))):
            i = rng.randrange(len(w))
            w[i : i + rng.choice([0, 1])] = rng.choice([[], ["changed"], ["new", "words"][:1]])
        clean = k % 3 == 0
        texts.append(prose("de", rng.randint(0, 80), rng) + " " + ("" if clean else " ".join(w).upper() + ", ") + prose("fr", 20, rng))
        d = plain_distance(items[k % 60].split(), decontam.words_in(texts[-1]))
        if d <= 0.2 * len(items[k % 60].split()):
            want[k] = (k % 60, d)
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, ""), (97, "not there")], "item_id long, text string")
    docs = table(spark, texts)
    out = {r.doc_id: (r.item_id, r.distance) for r in decontam.contaminated(docs, bench).collect()}
    assert set(out) <= set(want) and len(out) >= 0.98 * len(want) and all(out[k] == want[k] for k in out)
    kept = {r.doc_id for r in decontam.without_contaminated(docs, bench).collect()}
    assert kept == set(range(300)) - set(out)


@pytest.mark.parametrize("words", [8, 10, 12, 15, 20, 30, 60])
def test_contamination_meets_its_target_recall(words):
    """Passages with as many edits as allowed, at random and evenly spread places, at any phase; shorter classes have other walks."""
    rng = random.Random(words)
    items = [(i, " ".join(f"w{rng.randrange(20000)}" for _ in range(words))) for i in range(400)]
    index, most = decontam.Index.over(items), int(words * (1 - decontam.SIMILARITY) + 1e-9)
    for rate in (0, most // 2, most):
        for even in (False, True):
            docs = []
            for _, t in items:
                w = t.split()
                for e in range(rate):
                    j = min(len(w) - 1, int((e + 0.5) / rate * len(w))) if even else rng.randrange(len(w))
                    kind = rng.randrange(3)
                    w[j : j + (kind > 0)] = ["other"] * (kind < 2)
                docs.append(" ".join(["before"] * rng.randrange(9) + w + ["after"] * 5))
            found = {a for a, b, *_ in index.search(docs) if a == b}
            assert len(found) >= (decontam.RECALL - 0.02) * len(items), (words, rate, even)


def test_short_items_are_found_word_by_word():
    items = [(1, "Two words"), (2, "alpha beta gamma delta epsilon"), (3, "one"), (4, "seven words that stand in this order"), (5, "..."), (6, "two  WORDS")]
    index = decontam.Index.over(items)
    assert index.ids == [1, 2, 3, 4, 6] and decontam.Index.over([]).walks == []
    docs = ["here are two, words.", "alpha beta gamma delta", "alpha beta gamma delta epsilon", "x seven words that stand in this order y", "One", "seven words that stand in that order", "two more words", None, ""]
    found = sorted((a, index.ids[b], lo, hi) for a, b, _, lo, hi in index.search(docs))
    assert found == [(0, 1, 2, 4), (0, 6, 2, 4), (2, 2, 0, 5), (3, 4, 1, 8), (4, 3, 0, 1)]


def test_contamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "x " * 20)], "item_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(odd, bench).collect()] == [6]
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(odd, bench.where("false")).count() == 0
    assert decontam.without_contaminated(odd, bench.where("false")).count() == odd.count()


# --- 10


def plain_nearest(rows, k=10):
    out = {}
    x = {i: np.array(v, float) for i, v in rows}
    for q in x:
        if q % 7 == 0:
            out[q] = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)[:k]
    return out


def test_nearest_has_its_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "TASK_VECTORS", 300)
    monkeypatch.setattr(ann, "TASK_QUERIES", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vecs = [(i, (centres[i % 20] + rng.normal(size=16) * 0.5).tolist()) for i in range(3000)] + [(i, [1.0] * 16) for i in range(3000, 4500)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [1.0]), (None, [1.0] * 16), (9006, [float("inf")] * 16)]
    t = spark.createDataFrame([(i, v, 1) for i, v in vecs + odd], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in ann.nearest(t, F.col("vec_id") % 7 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    want = plain_nearest(vecs)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    x = dict(vecs)
    assert all(math.isclose(s, math.dist(x[q], x[i]), rel_tol=1e-12, abs_tol=1e-12) for q in list(got)[:50] for s, i in got[q])
    assert all([i for _, i in got[q]] == [i for _, i in want[q]] for q in want if q >= 3000)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/embeddings.parquet"), reason="needs the driver's tables")
def test_nearest_recall_on_the_embeddings(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in t.where(ann.valid("embedding") & F.col("vec_id").isNotNull()).collect())
    x, got = np.array([v for _, v in rows], float), defaultdict(set)
    for r in ann.nearest(t, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for i, (q, _) in enumerate(rows):
        if q % 100 == 0:
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            hits.append(len(got[q] & {rows[j][0] for j in np.argsort(d, kind="stable")[:10]}) / 10)
    print(f"recall on sf0.1: {np.mean(hits):.4f} over {len(hits)} queries")
    assert np.mean(hits) >= 0.95


def test_lists_grow_with_the_rows_and_placing_is_sliced():
    assert [ann.list_count(n) for n in (0, 1, 5000, 10**6, 10**7, 10**10)] == [1, 1, 50, 2000, 6324, 16384]
    rng = np.random.default_rng(1)
    index = ann.Index.over(rng.normal(size=(300, 8)))
    x = rng.normal(size=(500, 8))
    nearest = ann.dots(x, index.centroids).argmin(1)
    row, own = index.homes(x)
    assert np.bincount(row).max() <= ann.COPIES and np.mean([nearest[i] in own[row == i] for i in range(500)]) > 0.95


def test_nearest_small_tables(spark):
    t = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(t, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [(r[1], r[2]) for r in got] == [(1, 2), (2, 2), (3, 1)]  # rows that share an id are found as rows of their own
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.5]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(twice, F.col("vec_id") == 0).collect())
    assert [g[:3] for g in got] == [(0, 1, 0), (0, 1, 0), (0, 2, 7), (0, 2, 7)] and got[0][3] == 0.5
    assert ann.nearest(t.where("false"), F.col("vec_id") == 0).count() == 0 and ann.nearest(t, F.col("vec_id") == 9).count() == 0
