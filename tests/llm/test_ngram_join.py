import random

import brute
import pytest
from pyspark.sql import functions as F

from seqwell.llm import ngram_join
from seqwell.llm.ngram_join import components, connected


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long, class string")
    out = components(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect())
    want = brute.components([(r[0], r[1]) for r in rows])
    assert got == sorted((k, *v) for k, v in want.items())


def edited(rng, words, share):
    return [rng.choice(["alpha", "beta", "gamma", f"n{rng.randrange(9999)}"]) if rng.random() < share else w for w in words]


def corpus(seed, groups=6, size=12):
    rng = random.Random(seed)
    texts, passage = [], [f"p{i}" for i in range(40)]
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 7, 60, 150]))]
        for _ in range(size):
            own = edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04]))
            if rng.random() < 0.2:
                own = own + passage
            if rng.random() < 0.1:
                own = own[: len(own) - rng.randrange(1, 4)]
            texts.append((" " if rng.random() < 0.7 else "\t\n").join(own).title() if rng.random() < 0.3 else " ".join(own))
    rng.shuffle(texts)
    rows = [(i * 3, t, 1, "x") for i, t in enumerate(texts)]
    return rows + [(100_001, None, None, None), (100_002, "", 0, ""), (100_003, " \n\t ", 0, ""), (100_004, "one", 0, ""), (100_005, "ONE", 0, ""), (100_006, "é é é é é É", 0, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, corpus(seed))


@pytest.mark.parametrize(("leaders", "growth"), [(4, 16), (1, 2)])
def test_all_pairs_across_components_are_decided_by_rounds_of_leaders(spark, monkeypatch, leaders, growth):
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    monkeypatch.setattr(ngram_join, "GROWTH", growth)
    check(spark, corpus(3, groups=2, size=25))


def test_hot_bucket_of_unlike_texts(spark):
    # 5,000 texts of four passages each, no two of the same four: they share their keys by the hundred, but none is alike
    rng = random.Random(6)
    passages = [" ".join(f"p{i}w{k}" for k in range(25)) for i in range(50)]
    chosen: dict[frozenset, tuple] = {}
    while len(chosen) < 5_000:
        own = rng.sample(range(50), 4)
        chosen.setdefault(frozenset(own), own)
    rows = [(i, " ".join(passages[k] for k in own)) for i, own in enumerate(chosen.values())]
    rows += [(10_000 + i, f"{t} {t.split()[0]}") for i, t in rows[:5]]
    out = {r.doc_id: r.component_id for r in components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c == (k if k < 10_000 else k - 10_000) for k, c in out.items()) and len(out) == len(rows)


def test_words_of_structured_texts_do_not_collide(spark):
    # a polynomial modulo 2 ** 64 cannot tell the Thue-Morse word from its complement
    bits = [bin(i).count("1") % 2 for i in range(1 << 11)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits)), (3, "a" * 60 + "b"), (4, "a" * 60 + "c"), (5, "12345678a"), (6, "12345678b")]
    assert [r.component_id for r in components(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [1, 2, 3, 4, 5, 6]


def test_string_ids_and_very_long_texts(spark):
    rng = random.Random(7)
    long = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    rows = [("b", " ".join(long)), ("a", " ".join(long[:100_000] + ["z"] * 9)), ("c", " ".join(long[:80_008])), ("f", " ".join(long[:80_007] + ["y"])), ("d", "x" * 300_000), ("e", "x" * 300_000)]
    out = {r.doc_id: r.component_id for r in components(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    # c holds 80,004 of the 100,005 n-grams of a, one less were too few; f is linked with c
    assert out == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "a"}


def test_join_of_hot_keys(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k")
    other = spark.range(5000).selectExpr("id AS k", "id * 2 AS v")
    for how in ("inner", "left"):
        out = ngram_join.met(rows, other.where("k <> 8"), "k", "id", how)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, rows.join(other.where("k <> 8"), "k", how).collect()), key=str)


def test_common_ngrams_are_found_from_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    check(spark, corpus(4, groups=3, size=20))


def test_exact_threshold(spark):
    words = [f"a{i}" for i in range(13)]  # 9 shingles
    # 8 of 10 in common is a link, 8 of 11 is not
    check(spark, [(1, " ".join(words), 0, ""), (2, " ".join(words[:12] + ["z"]), 0, ""), (3, " ".join(words[:12] + ["y", "x"]), 0, "")])


def test_empty_and_repeated_rows(spark):
    assert components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = components(spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out) == [(0, 0, 0), (0, 1, 5), (5, 1, 5), (5, 1, 5)]


def test_connected_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 120)] + [(300, 119), (-7, -3)]
    roots = dict(connected(spark.createDataFrame(edges, "a long, b long")).select("node", "root").collect())
    assert all(roots[i] == 0 for i in range(1, 21)) and all(roots[x] == 100 for x in [*range(101, 120), 300]) and roots[-3] == -7


def test_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, component_id long").withColumn("n_shingles", F.lit("x"))
    assert [tuple(r) for r in components(docs).collect()] == [(1, 1, 1)]
