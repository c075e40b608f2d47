import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placeframe.llm import components, decontamination, langid, ngram_join, quality, quality_rules, sentencepiece_fst, sharding, suffix_dedup, tokens, toxicity, warc
from placeframe.session import materialise
from tests.llm import fixtures as X

ROWS = X.awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, X.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], X.SCHEMA)


def pairs():
    return [(r[0], r[1]) for r in ROWS]


# ---------------------------------------------------------------- sharding


def check_shards(got, rows, n_shards=16):
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32) for r in got) == sorted(((d is None, d or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    counts = [sum(r.shard == s for r in got) for s in range(n_shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(n_shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_shards_are_a_permutation(spark, docs, nothing):
    check_shards(sharding.assign(docs, bucket_rows=16).collect(), pairs())
    assert sharding.assign(nothing).count() == 0
    same = spark.createDataFrame([(7, "copy")] * 500 + [(None, None)] * 3, "doc_id long, text string")
    got = sharding.assign(same, bucket_rows=16).collect()
    check_shards(got, [(7, "copy")] * 500 + [(None, None)] * 3)


def test_the_seed_fixes_the_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_BYTES", 5000)
    rows = [(i, f"text {i * 7919 % 1000} {'x' * (i % 50)}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    draw = lambda df, seed: {r.doc_id: (r.shard, r.slot) for r in sharding.assign(df, seed=seed, bucket_rows=64).collect()}
    one = draw(df.repartition(2), 7)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "29")
        assert draw(df.repartition(11, "text"), 7) == one
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    other = draw(df, 8)
    assert sum(other[i] == one[i] for i in one) < 20
    follows = sum(one[i + 1] == (one[i][0], one[i][1] + 1) for i in range(1499))
    assert follows < 20  # neighbours of the input are no neighbours


def test_written_shards_hold_the_records(spark, docs, tmp_path):
    clash = docs.withColumns({"shard": F.col("bucket"), "size": F.lit("s"), "record": F.lit(1), "slot": F.lit(2.0), "__n": F.lit(3)})
    back = sharding.write_shards(clash, f"file://{tmp_path}/shards", n_shards=4).collect()
    assert sorted(map(repr, (r.record for r in back))) == sorted(map(repr, clash.collect()))
    assert len({(r.shard, r.slot) for r in back}) == len(ROWS) and len(list(tmp_path.glob("shards/shard=*"))) == 4
    got = sharding.assign(clash.drop("size", "slot", "shard").withColumn("size", F.lit(9)), 16)
    check_shards(got.collect(), pairs())


# ---------------------------------------------------------------- suffix dedup


def test_suffix_dedup_against_brute_force(docs, nothing):
    got = sorted(tuple(r) for r in suffix_dedup.digest(docs).collect())
    assert got == sorted(X.suffix_dedup(pairs()))
    assert suffix_dedup.digest(nothing).count() == 0


def test_hot_anchors_meet_by_window(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BATCHES", 2)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 4000)
    assert sorted(tuple(r) for r in suffix_dedup.digest(docs).collect()) == sorted(X.suffix_dedup(pairs()))
    monkeypatch.setattr(suffix_dedup, "HOT_BATCHES", 1)
    assert sorted(tuple(r) for r in suffix_dedup.digest(docs).collect()) == sorted(X.suffix_dedup(pairs()))


def test_hot_windows_travel_packed(docs):
    manifest, folder = suffix_dedup.spool(docs, "doc_id", "text")
    batch = manifest.first().batch
    _, buf, offs, ids = suffix_dedup.read_batch(folder, batch)
    a, _, bounds = suffix_dedup.distinct_anchors(suffix_dedup.anchored(buf, offs), ids, 4)
    hot = [np.packbits(np.ones(e - s, bool)).tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    rows = suffix_dedup._hot_windows(folder, 4)(pd.DataFrame({"batch": [batch] * 4, "bucket": range(4), "hot": hot}))
    assert len(a) > 100 and len(rows) == 5 and rows["bucket"].isna().sum() == 1


def test_slabs_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLAB", 300)
    rows = [(None if i == 3 else i, r[1]) for i, r in enumerate(ROWS[:30])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.digest(df).collect()), key=str)
    assert got == sorted(X.suffix_dedup(rows), key=str)


def test_dedup_keeps_columns(docs):
    clash = docs.withColumns({"n_removed": F.lit("mine"), "record": F.col("bucket"), "no_text": F.lit(1), "id": F.lit(2), "batch": F.array(F.lit(3)), "__n_removed": F.lit(4)})
    out = suffix_dedup.dedup(clash)
    rows = out.collect()
    assert out.schema["record"].dataType.names == clash.columns and len(rows) == len(ROWS)
    whole = sorted(map(repr, clash.collect()))
    assert sorted(repr(r.record) for r in rows if not r.n_removed) == [x for x in whole if x in {repr(r.record) for r in rows if not r.n_removed}]
    assert all(r.record["n_removed"] == "mine" and r.record["batch"] == [3] for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_deep_shallow_sort(seed):
    rng = random.Random(seed)
    text = b"".join(rng.choice((b"ab", b"abababab", b"cde" * 20, b"x")) for _ in range(400)) + b"q" * 60
    at = np.array(rng.sample(range(len(text) - 50), 300) + [5, 5, 5])
    suffix_dedup.SMALL, was = (0, 4, 48)[min(seed, 2)], suffix_dedup.SMALL
    try:
        order, fresh = suffix_dedup.deep_shallow_sort(np.frombuffer(text, np.uint8), at)
    finally:
        suffix_dedup.SMALL = was
    got = [text[p : p + 50] for p in at[order]]
    assert got == sorted(text[p : p + 50] for p in at)
    assert fresh.tolist() == [i == 0 or got[i] != got[i - 1] for i in range(len(got))]


def test_blind_trie_orders_strings():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(9)) for _ in range(200)]
    trie = suffix_dedup.BlindTrie()
    for i, s in enumerate(strings):
        trie.add(s, i)
    got = [[strings[i] for i in leaf] for leaf in trie.leaves()]
    assert [x[0] for x in got] == sorted(set(strings)) and all(len(set(x)) == 1 for x in got)


# ---------------------------------------------------------------- n-gram join


def test_ngram_join_against_brute_force(docs, nothing):
    got = sorted(tuple(r) for r in ngram_join.link(docs).collect())
    assert got == X.jaccard_components(pairs())
    assert ngram_join.link(nothing).count() == 0


def test_ngram_join_of_borderline_sets(spark):
    rng = random.Random(5)
    rows = []
    for g in range(60):
        base = X.words(rng, rng.randint(5, 90)).split(" ")
        for k in range(3):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 30)):
                w[rng.randrange(len(w))] = f"other{rng.randrange(10_000)}"
            rows.append((len(rows) + 1, " ".join(w[: len(w) - rng.randint(0, len(w) // 6)])))
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == X.jaccard_components(rows)


def test_groups_are_tested_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    assert sorted(tuple(r) for r in ngram_join.link(docs).collect()) == X.jaccard_components(pairs())


def test_one_row_of_each_component_stays(spark):
    a, b, c, d = (X.words(random.Random(i), 40) for i in range(4))
    rows = [(1, a, 0.1), (2, a, 0.2), (2, b, 0.3), (7, c, 0.4), (9, d, 0.5), (9, d, 0.5), (None, a, 0.6), (None, None, 0.7), (None, None, 0.7), (3, "", 0.8), (None, "only here without an id today", 0.9), (7, f"{c} more", 1.0)] + [(5, X.words(random.Random(9), 30), 1.0)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, __drop double").repartition(3)
    got = sorted(map(tuple, ngram_join.keep_one(df).collect()), key=str)
    assert got[:0] == [] and [r for r in got if r[0] != 7] == sorted([(1, a, 0.1), (2, b, 0.3), (5, rows[-1][1], 1.0), (9, d, 0.5), (None, None, 0.7), (None, None, 0.7), (3, "", 0.8), (None, "only here without an id today", 0.9)], key=str)
    assert len([r for r in got if r[0] == 7]) == 1 and ngram_join.keep_one(df).columns == df.columns
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_large_groups_are_divided(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "SPLIT", 1)
    assert sorted(tuple(r) for r in ngram_join.link(docs).collect()) == X.jaccard_components(pairs())
    rng = random.Random(6)
    common = X.words(rng, 30)
    rows = [(i, f"{common} {X.words(rng, rng.choice((3, 8, 20, 60)))}" if i % 3 else X.words(rng, rng.randint(1, 9))) for i in range(120)]
    rows += [(200 + i, t + " more") for i, t in rows[:40]]
    got = sorted(tuple(r) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == X.jaccard_components(rows)


def test_blocks_with_many_pairs_hand_on_the_closest_first(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "EVERY", 0)
    assert sorted(tuple(r) for r in ngram_join.link(docs).collect()) == X.jaccard_components(pairs())


def test_copies_send_no_keys(spark, monkeypatch):
    rows = [(k, X.words(random.Random(k % 5), 30)) for k in range(60)] + [(99, None)]
    held, groups = [], ngram_join._groups
    monkeypatch.setattr(ngram_join, "_groups", lambda sets, *a: held.append(sets.count()) or groups(sets, *a))
    got = sorted(tuple(r) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == X.jaccard_components(rows) and held == [5]
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_IDS", 0)
    assert sorted(tuple(r) for r in ngram_join.link(spark.createDataFrame(rows[:5] + rows[60:], "doc_id long, text string")).collect()) == X.jaccard_components(rows[:5] + rows[60:])


def test_a_line_that_is_everywhere_makes_no_large_group(spark, monkeypatch):
    rng = random.Random(5)
    line = X.words(rng, 40)
    rows = [(k, f"{X.words(rng, 130)} {line}") for k in range(250)]
    rows += [(250 + k, rows[k][1] + " " + X.words(rng, 8)) for k in range(0, 250, 25)]
    monkeypatch.setattr(ngram_join, "SAMPLE_ONE_IN", 1, raising=False)
    held, groups = [], ngram_join._groups
    monkeypatch.setattr(ngram_join, "_groups", lambda *a: held.append(groups(*a)) or held[0])
    monkeypatch.setattr(ngram_join, "discard", lambda *a: None)  # the groups' inputs stay
    got = sorted(tuple(r) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == X.jaccard_components(rows) and len({r[2] for r in got}) == 250
    assert max(r["count"] for r in held[0].groupBy("gid").count().collect()) < 20


def test_a_distance_beyond_what_is_asked_is_not_worked_out_in_full():
    h = np.random.default_rng(3).integers(0, 1 << 63, 4000, dtype=np.uint64)
    sizes = np.full(20, 200)
    rows = np.repeat(np.arange(20), 200)
    h[200:400] = h[:200]
    h[395:400] += np.uint64(12345)
    bits = ngram_join.Sketches(pa.array(ngram_join.sketches(h, rows, sizes), pa.binary()))
    a, b = (x.ravel() for x in np.triu_indices(20, 1))
    whole, some = bits.distance(a, b, np.full(len(a), 1 << 30)), bits.distance(a, b, np.full(len(a), 57))
    assert (some <= whole).all() and ((some <= 57) == (whole <= 57)).all()
    assert 0 < whole[0] <= 10 and some[0] == whole[0] and (some[1:] < whole[1:]).any()


def test_few_edges_take_no_rounds(spark, monkeypatch):
    from placeframe.llm import components as C

    edges = [(k, k + 1) for k in range(300)] + [(1000 + k, 1001) for k in range(50)]
    random.Random(3).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = sorted([(k, 0) for k in range(1, 301)] + [(1000 + k, 1000) for k in range(1, 50)])
    monkeypatch.setattr(C, "TASK_EDGES", 20)
    assert sorted(map(tuple, C.components(df).collect())) == want
    monkeypatch.undo()
    monkeypatch.setattr(C, "_star", None)
    assert sorted(map(tuple, C.components(df).collect())) == want


def test_linked_sets_share_a_key():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(1, 400)
        a = [rng.getrandbits(64) for _ in range(n)]
        b = a[: n - rng.randint(0, n // 7)] + [rng.getrandbits(64) for _ in range(rng.randint(0, n // 8))]
        if 100 * len({*a} & {*b}) < 75 * len({*a} | {*b}):
            continue
        h = np.concatenate([np.sort(np.array(a, np.uint64)), np.sort(np.array(b, np.uint64))])
        rows = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
        key, owner, void = ngram_join.part_keys(h, rows, np.array([len(a), len(b)]))
        assert {*key[owner == 0].tolist()} & {*key[owner == 1].tolist()}
        key, owner, void = ngram_join.part_keys(h, rows, np.array([len(a), len(b)]), 1)
        both = {*key[owner == 0].tolist()} & {*key[owner == 1].tolist()}
        assert len(both) >= 2 or both & {*key[void].tolist()}


def test_pack_round_trip():
    keys, nodes = np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.repeat(np.arange(1333, dtype=np.uint64), 3)
    got = {}
    for bucket, blob in ngram_join.pack(keys, nodes, 7):
        k, n = ngram_join.unpack(blob)
        got[bucket] = list(zip(k.tolist(), n.tolist(), strict=True))
    assert sum(map(len, got.values())) == len(keys)
    assert sorted(n for v in got.values() for _, n in v) == nodes.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 200: 100, 300: 100}


# ---------------------------------------------------------------- decontamination


ITEM = "A train leaves Paris at 9 km per hour and meets Anna after 35 minutes near the old stone bridge by the river"


MIXED = "Alpha has 7 apples and gives 7 pears to the shop while 7 cows look on from the long green hill today"
SUMS, SHORT = "What is 3 + 5 - 2 + 9 + 11 - 6 + 8 times 4?", "Compute 17 times 23 minus 5."


def test_decontamination(spark):
    other = "A train leaves London at 12 km per hour and meets Boris after 50 minutes near the old stone bridge by the river"
    items = spark.createDataFrame([(1, ITEM), (2, MIXED), (3, None), (4, "Too short"), (5, SUMS), (6, SHORT), (7, "***")], "item_id long, text string")
    plain = "Nothing of the kind is here at all, only plain words that go on."
    rows = [
        (1, f"Words before. {ITEM} and words after it."), (2, f"*** {ITEM.upper()} ***"), (3, f"Some text. {other}. The end."), (4, plain),
        (5, MIXED.replace("7", "9")), (6, MIXED.replace("7 apples", "9 apples")), (7, None), (8, ""), (9, ITEM[:40]), (10, ITEM.replace(" ", "\n", 3)),
        (11, f"{plain} {SUMS} {plain}"), (12, f"{plain} compute 17 times 23 minus 5 {plain}"), (13, "Compute 18 times 23 minus 5."), (14, f"{plain}\n too short! \n{plain}"), (15, f"It is too short a text. {plain}"),
        (16, " ".join(ITEM.split()[:9])), (17, f"{plain} {' '.join(ITEM.split()[2:16])}"), (1, f"Words before. {ITEM} and words after it."), (18, f"{'word ' * 20_000}{ITEM}"), (None, ITEM),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string").repartition(3)
    got = sorted(((r.doc_id or 0, r.item_id, r.kind) for r in decontamination.contaminated(df, items.unionByName(items.where("item_id = 4"))).collect()))
    verbatim = [(1, 1), (1, 1), (2, 1), (6, 2), (10, 1), (11, 5), (12, 6), (14, 4), (14, 4), (17, 1), (18, 1), (0, 1)]
    assert got == sorted([(d, i, "verbatim") for d, i in verbatim] + [(3, 1, "reparameterised"), (5, 2, "reparameterised")])
    kept = decontamination.keep_clean(df, items)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 7, 8, 9, 13, 15, 16]
    assert decontamination.contaminated(df, items.limit(0)).count() == 0 and decontamination.contaminated(df.limit(0), items).count() == 0
    assert {r.item_id for r in decontamination.unsearchable(items).collect()} == {3, 7}


def test_a_capital_within_a_line_costs_no_window(spark):
    item = "Every morning the old miller walks down to the river and counts the boats that pass below the bridge"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, f"we were told that {item} and so on")], "doc_id long, text string")
    total = len(item.split()) - 9
    got = decontamination.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.n_windows, r.item_windows, r.coverage, r.kind, r.n_slots) for r in got) == [(d, total, total, 1.0, "verbatim", 0) for d in (1, 2)]


def test_copies_against_brute_force(spark):
    rng = random.Random(22)
    items = [(i, X.words(rng, rng.choice((3, 5, 8, 12, 25))).capitalize()) for i in range(25)] + [(30, None), (31, "!?")]
    rows = []
    for k in range(150):
        w = items[k % 25][1].split()
        a = rng.randrange(len(w))
        part = " ".join(w[a : a + rng.randint(1, 20)]) if k % 3 else " ".join(w)
        rows.append((k, rng.choice(("\n", " ")).join((X.words(rng, 12), part.upper() if k % 5 == 0 else part, X.words(rng, 12)))))
    rows += [(200, None), (201, ""), rows[0]]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_windows, r.item_windows) for r in got if r.n_slots == 0 and r.kind == "verbatim") == sorted(X.copied(rows, items))


def test_reparameterised_items_are_found(spark):
    """Items of one text with other numbers and names; 95 in 100 at least are found, and nothing else is."""
    rng = random.Random(23)
    names, items, rows = ("Anna", "Boris", "Clara", "Dmitri", "Elena"), [], []
    for i in range(100):
        a, b = rng.sample(names, 2)
        make = lambda x, y, m, n, w=X.words(rng, 14).split(): " ".join([*w[:5], x, "buys", m, "apples and gives", n, *w[5:10], "to", y, *w[10:]])
        items.append((i, make(a, b, str(rng.randint(2, 40)), str(rng.randint(41, 90)))))
        c, d = rng.sample([n for n in names if n not in (a, b)], 2)
        rows.append((i, f"{X.words(rng, 30)} {make(c, d, str(rng.randint(100, 400)), str(rng.randint(401, 900)))} {X.words(rng, 30)}"))
    got = {(r.doc_id, r.item_id): r.kind for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got) >= 95 and all(d == i and kind == "reparameterised" for (d, i), kind in got.items())


def test_a_conflicting_slot_ends_a_stretch(spark):
    items = spark.createDataFrame([(2, MIXED)], "item_id long, text string")
    changed = MIXED.replace("Alpha has 7 apples", "Alpha has 9 apples").replace("long green hill", "high red hill")
    rows = [(6, changed), (8, changed[:50])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.contaminated(df, items).collect()
    assert [(r.doc_id, r.item_id, r.kind) for r in got] == [(6, 2, "verbatim")]
    assert {r.doc_id for r in decontamination.keep_clean(df, items).collect()} == {8}


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    texts = [X.words(rng, 30) for _ in range(40)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    df = spark.createDataFrame([(i, f"{X.words(rng, 30)} {t} {X.words(rng, 30)}" if i % 2 else X.words(rng, 90)) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 100)
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, items).collect()} == {(i, i) for i in range(1, 40, 2)}
    assert decontamination.keep_clean(df, items).count() == 20


# ---------------------------------------------------------------- quality rules


def test_base_counts_against_brute_force(docs, nothing):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(docs).collect()}
    assert {d: got[d] for d, _ in pairs()} == {d: X.base_counts(t) for d, t in pairs()}
    for r in quality_rules.judge(docs).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(nothing).count() == 0


def varied(rng):
    """(doc_id, text, lang, source) of groups with ways of their own, some junk, and small and null groups."""
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    text = lambda size, n=80, tail=lambda: "": " ".join(word(rng.choice(size)) + tail() for _ in range(n))
    hashes = lambda share: lambda: "#" if rng.random() < share else ""
    rows = [(text((4, 5, 6), rng.randint(40, 120)), "en", "plain") for _ in range(330)] + [(text((8, 9, 10)), "en", "plain") for _ in range(15)]
    rows += [(text((4, 5, 6), 80, hashes(0.2 + rng.random() / 5)), "en", "symbols") for _ in range(280)]
    rows += [(text((4, 5, 6), 80, hashes(0.3)), "en", "plain") for _ in range(15)]
    rows += [(text((7, 8, 9)), "de", "plain") for _ in range(300)] + [(text((2, 3)), "de", "plain") for _ in range(10)]
    rows += [(text((7, 8, 9)), "de", "small") for _ in range(20)] + [(text((4, 5, 6)), None, None) for _ in range(12)] + [(text((4, 5, 6), 80, lambda: "$$$"), None, None) for _ in range(3)]
    rows += [("\n".join(["the same line again here"] * 2 + [text((4, 5, 6), 9)] * 1), "en", "plain") for _ in range(3)]
    return [(i, *r) for i, r in enumerate(rows)]


def test_kept_against_brute_force(spark):
    rows = varied(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    expect = X.kept(rows, quality_rules.SPREAD, quality_rules.MIN_GROUP)
    assert {d for d in got if got[d] != expect[d]} == set()
    of = lambda a, b: [got[i] for i in range(a, b)]
    assert all(of(0, 330)) and not any(of(330, 345)) and all(of(345, 625)) and not any(of(625, 640)) and all(of(640, 940)) and not any(of(940, 950)) and all(of(950, 970))


def test_fences_follow_the_group(spark):
    rows = varied(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counted = quality_rules.measures(df)
    at = {(r["__lang"], r["__source"]): r for r in quality_rules.fences(counted).collect()}
    assert at["en", "plain"]["mid_word_length"] < at["de", "plain"]["mid_word_length"] - 1
    assert at["en", "symbols"]["mid_symbol_ratio_up"] > 0 == at["en", "plain"]["mid_symbol_ratio_up"]
    assert abs(at["de", "small"]["mid_word_length"] - at["de", "plain"]["mid_word_length"]) < 0.1


# ---------------------------------------------------------------- classifiers


def labelled(spark, mark, label, n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        y = i % 3 == 0
        rows.append((i, mark(rng, y)))
        labels.append((i, int(y)))
    rows += [(n, None), (n + 1, ""), (n + 2, rows[0][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, 0)], f"doc_id long, {label} int")


def accuracy(out, truth):
    held = [r for r in out if r.held_out and r.doc_id in truth]
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_toxicity(spark):
    bad = ("stupidhead", "wretched", "vileness")
    mark = lambda rng, y: " ".join(w + (" " + rng.choice(bad) if y and k % 12 == 5 else "") for k, w in enumerate(X.words(rng, 80).split(" ")))
    docs, labels = labelled(spark, mark, "toxic")
    out = toxicity.score(docs, labels).collect()
    assert accuracy(out, {i: int(i % 3 == 0) for i in range(400)}) >= 0.95
    by = {r.doc_id: r for r in out}
    assert len(out) == 403 and all(0 <= r.score <= 1 for r in out) and by[402].score == by[0].score and by[400].predicted == 0
    assert all(r.held_out == (X.fold(r.doc_id) == 0) and r.predicted == int(r.score >= 0.5) for r in out)
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}


def test_toxic_words_of_a_rare_language_are_learned():
    rng = random.Random(14)
    bad = {"en": ["stupidhead"], "de": ["quarkzwerg", "mistgabler", "schnoddrig", "flachzang"]}
    rows = []
    for i in range(2400):
        lang, y = "de" if i % 6 == 0 else "en", i // 6 % 5 == 0
        word = rng.choice(bad[lang]) if y else ""
        rows.append((i // 30 % 5, " ".join(f"{X.words(rng, 20)} {word}" for _ in range(4)), int(y), lang))
    model = toxicity.fit_rows([r for r in rows if r[0]])
    held = [r for r in rows if not r[0]]
    p = toxicity.D.probability(model, toxicity.features(model, toxicity.D.Sizes(model), [r[1].encode() for r in held]))
    for lang in bad:
        for y in (0, 1):
            hits = [(v >= 0.5) == y for v, r in zip(p, held, strict=True) if r[2:] == (y, lang)]
            assert len(hits) >= 10 and np.mean(hits) >= 0.9


def test_quality(spark):
    mark = lambda rng, y: X.words(rng, 80) if y else " ".join(w + rng.choice(("###", "$$$", "***")) for w in X.words(rng, 80).split(" "))
    docs, labels = labelled(spark, mark, "quality")
    out = quality.score(docs, labels).collect()
    assert accuracy(out, {i: int(i % 3 == 0) for i in range(400)}) >= 0.95
    assert len(out) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality.score(docs.limit(0), labels).count() == 0


def test_language_id(spark, nothing):
    rng = random.Random(8)
    syllables = {"aa": ("ka", "ro", "mi", "ta"), "bb": ("sch", "ung", "ver", "lich"), "cc": ("eau", "oux", "ée", "que")}
    text = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(30))
    rows = [(i, text(lang), lang, "s") for i, lang in enumerate(list(syllables) * 120)] + [(900, None, "aa", "s"), (901, "12 -- 3", "aa", "s"), (902, text("aa"), None, "s"), (903, "", "bb", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(df)
    out = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = [i for i in range(360) if X.fold(i) == 0]
    assert sum(out[i].lang_pred == rows[i][2] for i in held) / len(held) >= 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and out[i].rejected for i in (900, 901, 903)) and out[902].lang_pred == "aa"
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.rejected}
    assert langid.predict(nothing, langid.fit(nothing)).count() == 0
    foreign = spark.createDataFrame([(i, " ".join("".join(rng.choice(("zyx", "wqj", "vuk")) for _ in range(3)) for _ in range(30))) for i in range(30)], "doc_id long, text string")
    two = langid.fit(df.where("lang <> 'cc'"))
    assert langid.keep_known(foreign, two).count() == 0 and langid.keep_known(df.where("lang <> 'cc' and doc_id < 360"), two).count() == 240
    one = langid.fit(df.where("lang = 'aa'"))
    assert langid.keep_known(foreign, one).count() == 0
    assert {r.lang_pred for r in langid.predict(df.where("doc_id < 30"), one).collect()} == {"aa"}


def odd_texts():
    """What every classifier must score: no text, nothing in it, letters of all kinds, a very long text, copies."""
    return [(9001, None), (9002, ""), (9003, "   "), (9004, "É " * 40), (9005, "x" * 5000), (9006, X.words(random.Random(31), 60_000)), (9007, "a"), (9007, "a"), (None, "no id at all")]


def test_toxicity_scores_against_a_plain_version(spark):
    import zstandard

    mark = lambda rng, y: " ".join(w + (" Stupidhead" if y and k % 12 == 5 else "") for k, w in enumerate(X.words(rng, 80).split(" ")))
    docs, labels = labelled(spark, mark, "toxic")
    docs = docs.unionByName(spark.createDataFrame(odd_texts(), docs.schema))
    m = toxicity.fit(docs, labels)
    plain = {}
    params = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=0, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
    both = [zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (m.ordinary, m.special)]
    for r in docs.collect():
        t = (r.text or "").encode().lower()
        windows, i = [], 0
        while len(t) - i > m.window:
            j = t.find(b" ", i + m.window, i + 2 * m.window)
            j = j if j > 0 else i + m.window
            windows.append(t[i:j])
            i = j
        d = [len(both[0].compress(w)) - len(both[1].compress(w)) for w in (*windows, t[i:])]
        top = (sorted(d, reverse=True) + [0] * toxicity.TOP)[: toxicity.TOP]
        over = [x for c in m.thresholds for x in (np.log1p(sum(v >= c for v in d)), sum(v >= c for v in d) / len(d))]
        x = [np.log(len(d)), sum(d) / len(d), *top, *over]
        z = sum(w * (v - c) / k for w, v, c, k in zip(m.weights, x, m.centre, m.scale, strict=False)) + m.weights[-1]
        plain[r.text] = 1 / (1 + np.exp(-min(30, max(-30, z))))
    for r in toxicity.score(docs, labels).join(docs.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i"))).collect():
        assert abs(r.score - plain[r.text]) < 1e-9 and r.held_out == (r.doc_id is None or X.fold(r.doc_id) == 0)


def test_quality_scores_against_a_plain_version(spark):
    import zstandard

    mark = lambda rng, y: X.words(rng, 80) if y else " ".join(w + rng.choice(("###", "$$$", "***")) for w in X.words(rng, 80).split(" "))
    docs, labels = labelled(spark, mark, "quality")
    docs = docs.unionByName(spark.createDataFrame(odd_texts(), docs.schema))
    m = quality.fit(docs, labels)
    both = [zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (m.ordinary, m.special)]
    xs, ys = m.knots
    assert xs == sorted(xs) and ys == sorted(ys) and 0 < ys[0] < ys[-1] < 1

    def plain(text):
        t = (text or "").encode()
        saved = sum(len(both[0].compress(w)) - len(both[1].compress(w)) for w in quality.D.pieces(t, m.window)) / max(1, len(t))
        if saved <= xs[0] or saved >= xs[-1]:
            return ys[0] if saved <= xs[0] else ys[-1]
        k = next(i for i in range(len(xs)) if xs[i + 1] >= saved)
        return ys[k] + (ys[k + 1] - ys[k]) * (saved - xs[k]) / (xs[k + 1] - xs[k])

    for r in quality.score(docs, labels).join(docs.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i"))).collect():
        assert abs(r.score - plain(r.text)) < 1e-9


def test_language_scores_against_a_plain_version(spark):
    rng = random.Random(18)
    syllables = {"aa": ("ka", "ro", "mi", "ta"), "bb": ("sch", "ung", "ver", "lich"), "cc": ("eau", "oux", "ée", "que")}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(20)), lang) for i, lang in enumerate(list(syllables) * 60)] + [(i, t, None) for i, t in odd_texts()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(df)
    low = lambda b: b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32

    def plain(text):
        b = [low(x) for x in (text or "").encode()]
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        hashes = [((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 2654435761 % 2**32) >> (32 - langid.BITS) for i in range(len(b) - 2)]
        hashes += [(((b[i] | b[i + 1] << 8 | b[i + 2] << 16 | b[i + 3] << 24) * 2246822519 % 2**32) >> (32 - langid.BITS)) + 2**langid.BITS for i in range(len(b) - 3)]
        total = m.logits[hashes, :-1].astype(float).sum(0) if hashes else np.zeros(len(m.langs))
        z = (total / max(1, len(hashes)) + m.bias) / m.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        return m.langs[int(p.argmax())], float(p.max())

    for r in langid.predict(df, m).join(df.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i"))).collect():
        lang, score = plain(r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6


def test_dirty_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = [(i, f"ka ro mi ta {'lo' * (i % 5)}", "aa") for i in range(60)] + [(100 + i, f"schung verlich {'ob' * (i % 5)}", "bb") for i in range(50)] + [(200 + i, "eau oux", f"dirt{i}") for i in range(40)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["aa", "bb"]


def test_long_texts_equal_short_chunks():
    text = ("the tion ing " * 5000).encode()
    buf = np.frombuffer(text, np.uint8)
    model = langid.Model(["a", "b"], np.random.default_rng(0).normal(size=(2 << langid.BITS, 3)).astype(np.float32), np.zeros(2))
    whole, _ = langid.probabilities(model, buf, np.array([0, len(buf)]))
    pair, _ = langid.probabilities(model, np.r_[buf, buf], np.array([0, len(buf), 2 * len(buf)]))
    assert np.allclose(pair[0], whole[0]) and np.allclose(pair[1], whole[0])


# ---------------------------------------------------------------- sentencepiece


def encoded(machine, texts):
    import pyarrow as pa

    encoder, out = sentencepiece_fst.Encoder(machine), []
    for _, buf, offs in tokens.chunks(pa.array(texts, pa.string()), 20_000):
        ids, at = encoder.encode(buf, offs)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def test_transducer_equals_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_PATH)
    rng = random.Random(11)
    texts = [t for _, t in pairs() if t is not None] + ["\u2581", " ", "  a  ", "x" * 3000, "aeiou" * 400]
    texts += ["".join(rng.choice("ab  the\n\té語🙂1230xyzing ' ÀÈ▁") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    for t, got in zip(texts, encoded(sentencepiece_fst.machine(), texts), strict=True):
        assert got == library.encode(t), t[:80]


def test_few_known_arcs_and_small_lattices_change_nothing(monkeypatch):
    texts = [t for _, t in pairs()]
    whole = encoded(sentencepiece_fst.machine(), texts)
    monkeypatch.setattr(sentencepiece_fst, "KNOWN_ARCS", 16)
    monkeypatch.setattr(sentencepiece_fst, "LATTICE", 40)
    assert encoded(sentencepiece_fst.machine(), texts) == whole


def unigram(squeeze=False, prefix=False):
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "aba": -4.0, "\u2581": -3.0, "\u2581a": -3.2}
    surface = [p.replace("\u2581", " ").encode() for p in scores] + [bytes([b]) for b in range(256)]
    return sentencepiece_fst.Vocabulary({p: i for i, p in enumerate(scores)}, scores, list(range(6, 262)), surface, True, prefix, squeeze, True)


def test_unigram_path_is_the_cheapest():
    v = unigram()
    machine = sentencepiece_fst.build(v)

    def cheapest(t):
        best = [(0.0, ())] + [None] * len(t)
        for i in range(1, len(t) + 1):
            ways = [(best[j][0] - v.scores[t[j:i]], (*best[j][1], v.pieces[t[j:i]])) for j in range(i) if t[j:i] in v.pieces]
            best[i] = min(ways, key=lambda x: x[0])
        return best[-1]

    rng = random.Random(3)
    texts = ["abab", "aab"] + ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 20))) for _ in range(200)]
    names = {i: p for p, i in v.pieces.items()}
    for t, got in zip(texts, encoded(machine, texts), strict=True):
        assert "".join(names[i] for i in got) == t.replace(" ", "\u2581")
        assert abs(-sum(v.scores[names[i]] for i in got) - cheapest(t.replace(" ", "\u2581"))[0]) < 1e-9
    assert encoded(machine, ["aqa"]) == [[0, 6 + ord("q"), 0]] and encoded(machine, ["é"]) == [[6 + 0xC3, 6 + 0xA9]]


@pytest.mark.parametrize("prefix", (False, True))
@pytest.mark.parametrize("squeeze", (False, True))
def test_normaliser(squeeze, prefix):
    import re

    m = sentencepiece_fst.build(unigram(squeeze, prefix)).normaliser
    texts = ["", " ", "  a", "a  b ", "a", " a b  ", "ab", "   "]
    points = np.array([ord(c) for t in texts for c in t], np.uint32)
    out, at = m.run(points, np.r_[0, np.cumsum([len(t) for t in texts])])
    got = ["".join(map(chr, out[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]

    def expect(t):
        t = re.sub(" +", " ", t).strip(" ") if squeeze else t
        return ((" " if prefix else "") + t).replace(" ", "\u2581") if t else ""

    assert got == [expect(t) for t in texts]


def test_encode_decode_frame(docs, nothing):
    enc = materialise(sentencepiece_fst.encode(docs), "encoded")
    got = {r.doc_id: r for r in enc.collect()}
    back = {r.doc_id: r.text for r in sentencepiece_fst.decode(enc).collect()}
    for d, t in pairs():
        assert back[d] == t and (got[d].ids is None) == (t is None) and got[d].round_trip == (t is not None)
    assert sentencepiece_fst.encode(nothing).count() == 0


# ---------------------------------------------------------------- warc


def pages_fixture():
    rng = random.Random(12)
    big = ["<html>" + X.words(rng, 400) for _ in range(6)]
    rows = [(i, f"http://{'www.' if i % 2 else ''}site{i % 4}.example.com:80/p/{i % 9}?b=2&a={i}#f", big[i % 6] if i % 3 else f"small {i % 5}") for i in range(60)]
    return rows + [(60, None, None), (61, "", ""), (None, "http://x.example/", big[0]), (62, "http://[bad/\r\nX: y", big[1]), (5, "http://again.example/", big[5])]


def test_warc_round_trip_and_revisits(spark):
    rows = pages_fixture()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(4)
    got = warc.archive_and_index(pages).collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            top[h] = max(top.get(h, i), i)
    expect = sorted((i is None, i or 0, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h in top and (i is None or i < top[h]) else "response", top[h] if h in top and (i is None or i < top[h]) else -1) for i, _, h in rows)
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == expect
    order = sorted(got, key=lambda r: (r.merge_range, r.position))
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in order]
    assert keys == sorted(keys)
    manifest = warc.write(pages)
    bodies = {r.page_id: bytes(r.payload).decode() for r in warc.payloads(spark, manifest).collect()}
    assert all(bodies[r.page_id] == dict((i, h) for i, _, h in rows if not (i == 5 and h is None))[r.page_id] for r in got if r.record_type == "response" and r.page_id not in (None, 5, 60))
    assert warc.archive_and_index(pages.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(13)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("HTTP://www.Example.com:80/A?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert warc.url_key("https://m.example.org:8443") == "org,example,m:8443)/"


# ---------------------------------------------------------------- primitives


def test_span_hashes_depend_on_bytes_alone():
    buf = np.frombuffer(b"abcabc xyz abc", np.uint8)
    h = tokens.span_hash(tokens.prefix(tokens.byte_values(buf)), np.array([0, 3, 11, 7]), np.array([3, 6, 14, 10]))
    assert h[0] == h[1] == h[2] != h[3]


def test_words_match_the_pattern():
    texts = [t for _, t in pairs()]
    import pyarrow as pa

    for first, buf, offs in tokens.chunks(pa.array(texts), 5000):
        s, e, row = tokens.words(buf, offs)
        got: dict[int, list[str]] = {}
        for a, b, r in zip(s.tolist(), e.tolist(), row.tolist(), strict=True):
            got.setdefault(r, []).append(buf[a:b].tobytes().decode())
        for r in range(len(offs) - 1):
            assert got.get(r, []) == X.WORD.findall(texts[first + r] or "")


def test_nothing_else_imports_this_subpackage():
    from pathlib import Path

    root = Path(tokens.__file__).resolve().parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "placeframe.llm" in p.read_text()]


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert F is not None
