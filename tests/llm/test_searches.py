"""The filter audit and the two searches against plain versions."""

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeframe.llm import filter_audit, ranked_search, topk_search
from tests.llm import fixtures as X

# ---------------------------------------------------------------- filter audit


def plain_audit(rows, labels):
    marks = {}
    for d, q, t in labels:
        if d is not None:
            g, x = marks.get(d, (0, 0))
            marks[d] = (g or q == 1, x or t == 1)
    first = {}
    late = lambda d: (d is None, d or 0)
    for d, text, _ in rows:
        first[text or ""] = min(first.get(text or "", (True, 0)), late(d))
    docs = []
    for d, text, lang in rows:
        t = text or ""
        w = X.WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": first[t] < late(d)}
        docs.append((lang or "", {f for f in fails if fails[f]}, *marks.get(d, (0, 0))))
    out = {}
    for part in {p for p, *_ in docs}:
        own = [x for x in docs if x[0] == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] and bool(x[1] & set(order[:step])) for x in own)
                left = [x for x in left if f not in x[1]]
                removed[f] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in own), sum(bool(x[2]) for x in gone), sum(bool(x[3]) for x in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v.append(removed[v.pop()])
    return {k: tuple(v) for k, v in out.items()}


def test_the_audit_of_filters(spark):
    rng = random.Random(4)
    rows = [(r[0], r[1], r[2]) for r in X.awkward()]
    long = [" ".join(rng.choice(("Alpha", "beta", "GAMMA", f"w{k}")) for k in range(250)) for _ in range(12)]
    varied = [" ".join(f"w{k * j}" for k in range(1, 240)) for j in range(1, 9)]
    rows += [(1000 + k, t, "en") for k, t in enumerate(long + varied + long[:5] + varied[:3])]
    rows += [(None, varied[0], "en"), (None, varied[0], "fr"), (None, "only here", None), (None, "only here", None), (5000, None, ""), (5000, None, "")]
    labels = [(r[0], k % 3 == 0, k % 4 == 0) for k, r in enumerate(rows)] + [(1003, 1, 1), (None, 1, 1), (1004, None, None)]
    labels = [(d, None if q is None else int(q), None if t is None else int(t)) for d, q, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "mask": F.lit("x")}).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(docs, marks).collect()}
    assert got == plain_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_each_outcome_of_a_mask_is_one(spark):
    m = filter_audit.outcome_matrices()
    assert all(x.shape == (32, 600) for x in m.values())
    fails = m["removed"] + m["redundant"]
    for o, order in enumerate(filter_audit.ORDERS):
        for s, f in enumerate(order):
            assert (fails[:, 5 * o + s] == (np.arange(32) >> f & 1)).all()
    assert (m["kept"][:, 4::5] == (np.arange(32) == 0)[:, None]).all()


# ---------------------------------------------------------------- exact top-k


def plain_topk(rows, k=10, every=100):
    ok = [(n, i, [math.floor(1024 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j or 0) for m, j, v in ok if m != n)[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found)]
    return sorted(out, key=str)


def vectors(seed, n=700, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    v = (centres[rng.integers(6, size=n)] + 0.2 * rng.normal(size=(n, d))) * rng.choice([0.1, 1, 3], size=(n, 1))
    return [(int(i), [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


def topk(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "row": F.lit("a"), "rank": F.lit(2)}).repartition(3)
    return sorted((tuple(r) for r in topk_search.search(df, **more).select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("more", [{}, {"block_rows": 50, "sample_rows": 40, "pivots": 3}, {"block_rows": 7, "sample_rows": 4}])
def test_topk_equals_brute_force(spark, more):
    rows = vectors(3)
    twin = rows[5][1]
    rows += [(701 + k, twin) for k in range(30)]  # ties
    rows += [(None, twin), (None, rows[8][1]), (900, None), (1000, [1.0, None] + [0.0] * 10), (1100, [float("nan")] * 12), (1200, [float("inf")] + [0.0] * 11), (-100, rows[9][1]), (1300, []), (1400, [0.0] * 12), (1500, [0.25, -0.5])]
    assert topk(spark, rows, **more) == plain_topk(rows)


def test_topk_of_repeated_rows_and_of_few(spark):
    rows = vectors(5, n=90)
    rows += [rows[0], rows[0], rows[7]]
    assert topk(spark, rows) == plain_topk(rows)
    few = vectors(6, n=4)
    assert topk(spark, few) == plain_topk(few) and len(topk(spark, few)) == 3
    assert topk(spark, few[:1]) == [] and topk(spark, [(100, None)]) == [] and topk(spark, []) == []


def test_topk_of_large_components_is_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 1e5]) for i in range(150)]
    assert topk(spark, rows, block_rows=20) == plain_topk(rows)
    with pytest.raises(Exception, match="too large"):
        topk(spark, [(0, [1e30]), (1, [1.0])])


def test_pivots_spare_evaluations():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 300
    v = (centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16)) * 10).astype(np.int64)
    space = topk_search.Space(16, float((v.astype(float) ** 2).sum(1).max()), v[:0], v[:500], np.arange(500), 10)
    space.pivots = v[:500][topk_search.farthest_first(v[:500], space.lift(v[:500]), 32)]
    block = topk_search.Block(space, np.arange(4000), np.arange(4000), v, space.distances(v, False))
    for k in range(600, 640):
        best, scores = block.search(v[k], space.distances(v[k : k + 1], True)[0], k, space.first_score(v[k], k))
        s = v @ v[k]
        s[k] = -(2**62)
        want = np.lexsort((np.arange(4000), -s))[:10]
        assert best.tolist() == want.tolist() and scores.tolist() == s[want].tolist()
    assert block.evaluated < 40 * 4000 / 4


# ---------------------------------------------------------------- ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_search(docs, items, k=20):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = lambda t: TERM.findall((t or "").translate(low))
    lists = [(d, terms(t)) for d, t in docs]
    total, length = sum(bool(x) for _, x in lists), sum(len(x) for _, x in lists)
    df = {}
    for _, x in lists:
        for t in set(x):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for d, x in lists:
            if not x:
                continue
            m = 100 - 25 + (25 * len(x) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * x.count(t)) // (1000 * x.count(t) + 12 * m)) for t in terms(text) if t in df)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "term": F.lit("x"), "n": F.lit(None).cast("string")}).repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    return sorted((tuple(r) for r in ranked_search.search(d, i, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(("k", "more"), [(20, {}), (3, {"segment_postings": 900, "block_items": 4})])
def test_ranked_search_equals_brute_force(spark, k, more):
    rng = random.Random(12)
    common = [f"t{n}" for n in range(12)]
    rare = [f"r{n}" for n in range(300)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.7 else rng.choice(rare) for _ in range(n))
    docs = [(n, text(rng.randint(1, 90))) for n in range(400)] + [(r[0] + 10_000, r[1]) for r in X.awkward()]
    docs += [(500 + n, docs[3][1]) for n in range(40)] + [docs[3], docs[3], (None, docs[3][1]), (None, text(20)), (9000, None), (9001, ""), (9002, "...,;"), (9003, "T1 T1,t1-R5 É é"), (9004, text(20_000))]
    items = [(n, text(rng.randint(1, 40))) for n in range(15)] + [(50, docs[3][1]), (51, "T1 t1 T1"), (52, None), (53, ""), (54, "nowhere"), (55, "É"), (None, "r7 r8"), (56, "r9"), (56, "r9"), (57, "the THE tion é")]
    assert ranked(spark, docs, items, k=k, **more) == plain_search(docs, items, k)


def test_ranked_search_of_nothing(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a b")], []) == [] and ranked(spark, [(1, None)], [(1, None)]) == []
    assert ranked(spark, [(1, "a b"), (2, "b")], [(9, "a b b")]) == plain_search([(1, "a b"), (2, "b")], [(9, "a b b")])


def test_the_bit_table_lets_every_term_of_an_item_pass(spark):
    items = spark.createDataFrame([(n, " ".join(f"word{n * 40 + m}" for m in range(40))) for n in range(200)], "item_id long, text string")
    terms = ranked_search.item_terms(items, "item_id", "text")
    bits = np.frombuffer(ranked_search.bit_table(terms), np.uint8)
    assert len(bits) == 1 << 21
    slots = np.array([r.slot for r in terms.select("slot").collect()])
    assert len(slots) == 8000 and ((bits[slots >> 3] >> (slots & 7)) & 1).all() and np.unpackbits(bits).sum() == len(set(slots))
