"""Jaccard join, leaderboard feed and vector codes against plain versions, and on odd rows."""

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import jaccard, leaderboard, similar, simhash, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _rid long, n long, h long, rep long"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, t, "en", "s", 1, 7, 8, 9, 10) for i, t in enumerate(texts)], DOCS)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([" ".join(w)] if 0 < len(w) < k else [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)])


def plain_components(texts, percent, k):
    sets, parent = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def family(rng, n, copies, edits):
    """A text and copies of it, each with some words replaced; a copy may also be cut short."""
    base = [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = [" ".join(base)]
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(n)] = f"e{rng.randrange(99999)}"
        out.append(" ".join(own[: n - rng.randint(0, edits)]))
    return out


def some_texts(seed=3):
    rng = random.Random(seed)
    texts = ["", None, " \t\n", "one", "One", "one two", "a b c d", "a\x85b c d e f", "the same text here again", "The same text here again", "x " * 3000]
    for n, copies, edits in ((8, 6, 1), (20, 8, 1), (60, 12, 4), (300, 25, 9), (301, 10, 30), (1200, 6, 40)):
        texts += family(rng, n, copies, edits)
    line = " ".join(f"l{i}" for i in range(12))
    texts += [line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 4))) for _ in range(20)]
    return texts


@pytest.mark.parametrize("limits", [{}, {"TOGETHER": 3}, {"ROWS": 6}, {"SHINGLES": 900}, {"TOGETHER": 1, "COMMON": 2, "ROWS": 5}])
def test_jaccard_components(spark, monkeypatch, limits):
    """Whole results with buckets, hot shingles and clusters of any size, also where every limit is small."""
    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    texts = some_texts()
    out = jaccard.jaccard_components(documents(spark, texts), 85, 4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == plain_components(texts, 85, 4)


def test_jaccard_of_other_words_and_percent(spark):
    texts = some_texts(5)
    out = jaccard.jaccard_components(documents(spark, texts), 80, 5)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == plain_components(texts, 80, 5)


def test_jaccard_odd_ids_and_empty(spark):
    texts = ["one two three four five", "one two three four five", None, "", "other words are in here", "other words are in here"]
    out = jaccard.jaccard_components(documents(spark, texts, [None, 4, 5, None, None, None]))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=repr)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (5, 0, 5), (None, 0, None), (None, 2, None), (None, 2, None)], key=repr)
    assert jaccard.jaccard_components(documents(spark, ["a"]).where("false")).count() == 0


def test_one_shingle_in_very_many_rows(spark):
    """A line that 100,000 short texts share, as a third of the words of each: nothing links, and no task holds them all."""
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("all texts begin with these words "), *(F.concat(F.lit(f" {c}"), F.col("id").cast("string")) for c in "abcdefgh")).alias("text"))
    out = jaccard.jaccard_components(rows, 80, 5)
    assert out.where("component_id <> doc_id").count() == 0 and out.count() == 100_000


def test_bounds_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(2)
    for n in (6, 13, 40, 257, 1025):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            keep = a[rng.random(len(a)) > 0.08]
            b = np.unique(np.r_[keep, rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 10) + 1))).astype(np.uint64)])
            real = bool(jaccard.enough(jaccard.overlap_of(a, b), len(a) + len(b), 85))
            (c, e), (d, f) = jaccard.group_counts(a), jaccard.group_counts(b)
            found = jaccard.linked([c, d], np.array([len(a), len(b)]), np.array([e, f]), 85)
            assert found or not real
            assert bool(jaccard.sets_linked([a, b], 85)) == real
    one = np.zeros(400, np.uint64) + np.arange(400, dtype=np.uint64) * np.uint64(512)  # all in one group
    counts, excess = jaccard.group_counts(one)
    assert counts.max() == 15 and excess == 385 and (jaccard.unpacked(jaccard.packed(counts)) == counts).all()
    assert jaccard.linked([counts, counts], np.array([400, 400]), np.array([excess, excess]), 85)


def test_near_dedup_keeps_clashing_columns_and_one_of_each_group(spark):
    texts = some_texts(8)
    docs = documents(spark, texts)
    for out in (similar.one_of_each_group(docs), simhash.one_of_each_group(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and all((r._rid, r.n, r.h, r.rep) == (7, 8, 9, 10) for r in rows)
    kept = {r.doc_id for r in similar.one_of_each_group(docs).collect()}
    left = [t if i in kept else None for i, t in enumerate(texts)]
    assert all(i == root for i, n, root in plain_components(left, 80, 5) if n)


def plain_feed(lines, vendors, items, keep=10):
    nation, price = dict(vendors), dict(items)
    arrived, days_of = defaultdict(list), defaultdict(list)
    for sale, no, item, vendor, quantity, amount, flag, shipped in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, no)).encode())
        s = (shipped.date() - dt.date(1970, 1, 1)).days if shipped else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        batch = min(8, 1 + math.floor((a - 19723) * 8 / 180))
        p = price.get(item)
        cents = math.floor(100 * amount + 0.5) if amount is not None else quantity * math.floor(100 * p + 0.5) if quantity is not None and p is not None else 0
        days_of[batch].append(s)
        arrived[batch, a].append((nation.get(vendor), item, s, -cents if flag == "swapped" else cents, item in price))
    revenue, boards, out, top = defaultdict(int), defaultdict(list), [], None
    for batch in sorted(days_of):
        for a in sorted(a for b, a in arrived if b == batch):
            touched = set()
            for n, item, s, cents, known in arrived[batch, a]:
                if n is not None and known and (top is None or s + 15 >= top):
                    revenue[n, item] += cents
                    touched.add(n)
            for n in touched:
                now = [i for _, i in sorted((-v, i) for (m, i), v in revenue.items() if m == n and v > 0)[:keep]]
                old = boards[n]
                for i in {*now, *old}:
                    x, y = (b.index(i) + 1 if i in b else None for b in (old, now))
                    if x != y:
                        out.append((n, a, i, batch, "enter" if x is None else "exit" if y is None else "move", x, y, revenue[n, i]))
                boards[n] = now
        top = max([*days_of[batch], *([top] if top is not None else [])])
    return sorted(out, key=repr)


SALE_LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz, grp int, batch int, day long"


@pytest.mark.parametrize("shape", [{}, {"leaf_items": 3, "fan": 2}])
def test_leaderboard(spark, shape):
    rng = random.Random(9)
    vendors = [(v, rng.choice([0, 1, 1, 1, None])) for v in range(9)]
    items = [(i, rng.choice([None, 1.005, 20.0, 7.77])) for i in range(40)]
    lines = []
    for i in range(1500):
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(148), hours=rng.randrange(24))
        lines.append((rng.choice([None, *range(300)]), rng.choice([None, 1, 2, 3]), rng.choice([None, 7, 7, 7, *range(45)]), rng.choice([None, 3, 3, *range(11)]), rng.choice([None, 1, 5]), rng.choice([None, 0.0, round(rng.uniform(1, 300), 2)]), rng.choice(["kept", "kept", "swapped", None]), rng.choice([None, day, day, day])))
    lines += lines[:60]
    frames = spark.createDataFrame([(*x, 1, 2, 3) for x in lines], SALE_LINES), spark.createDataFrame(vendors, "vendor_id long, nation_id int"), spark.createDataFrame(items, "item_id long, price double")
    got = leaderboard.leaderboard_changes(*frames, **shape).collect()
    assert sorted(map(tuple, got), key=repr) == plain_feed(lines, vendors, items)
    if not shape:
        assert leaderboard.leaderboard_changes(frames[0].where("false"), *frames[1:]).count() == 0


def plain_codes(rows, rounds=2, entries=64, parts=16):
    kept = sorted(((i, v, label) for i, v, label in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    points = np.floor(np.array([v for _, v, _ in kept]) * 256).astype(np.int64).reshape(len(kept), parts, -1)
    books = points[:entries].transpose(1, 0, 2).copy()
    nearest = lambda: np.stack([((points[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)])
    for _ in range(rounds):
        z = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = points[z[p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    z = nearest()
    error = sum(((points[:, p] - books[p, z[p]]) ** 2).sum(1) for p in range(parts))
    return sorted(((i, "".join(f"{e:02x}" for e in z[:, k]), int(error[k]), label) for k, (i, _, label) in enumerate(kept)), key=repr), books


VECTORS = "vec_id long, embedding array<float>, label int, code string, error int, n int"


def test_vector_codes(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 100)
    rng = np.random.default_rng(4)
    same = rng.normal(0, 0.1, 32).astype(np.float32).tolist()
    rows = [(int(i), rng.normal(0, 0.2, 32).astype(np.float32).tolist(), int(rng.integers(0, 5)) if i % 7 else None) for i in range(500)]
    rows += [(1000 + i, same, 9) for i in range(250)] + [(2000, None, 1), (2001, [None] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [float("inf")] * 32, 2), (None, same, None), (3, same, 1), (3, rows[3][1], 1), (2004, [], 1)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], VECTORS)
    want, books = plain_codes(rows)
    codes = vector_codes.encode(df.repartition(3))
    got = vector_codes.with_label_errors(codes.rows).collect()
    assert sorted(((r.id, bytes(r.code).hex(), r.error, r.label) for r in got), key=repr) == want
    assert (codes.books == books).all() and codes.digest == hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = defaultdict(int)
    for _, _, error, label in want:
        sums[label] += error
    assert all(r.label_error == sums[r.label] for r in got)
    back = {(r.id, bytes(r.code)): r.vector for r in vector_codes.decode(codes.rows, codes.books).collect()}
    for (_, code), v in back.items():
        assert v == pytest.approx(np.concatenate([books[p, e] for p, e in enumerate(code)]) / 256)


def test_vector_codes_of_few_and_no_rows(spark):
    rows = [(5, [0.5] * 16, 1), (2, [0.25] * 16, None), (7, [0.5] * 16, 1), (9, [0.5] * 32, 1)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], VECTORS)
    got = {r.id: (bytes(r.code).hex(), r.error) for r in vector_codes.encode(df).rows.collect()}
    assert got == {2: ("00" * 16, 0), 5: ("01" * 16, 0), 7: ("01" * 16, 0)}
    none = vector_codes.encode(df.where("false"))
    assert none.rows.count() == 0 and none.digest == hashlib.sha256(b"").hexdigest()
