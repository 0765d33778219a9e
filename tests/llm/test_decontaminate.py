import random
import re

import numpy as np
import pytest

from seqwell.llm import decontaminate as d

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for key, item in items:
        w = words(item)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            part = w[i : i + window]
            for j in range(len(own) - len(part) + 1):
                if own[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(key)
    return len(own), len(hit), sorted(found - {None})


def rows():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "naïve", "x1"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([12, 15, 30])))) for i in range(8)] + [(20, "w1 w2, W3"), (21, "w5"), (22, None), (23, "..."), (None, " ".join(say(14))), (24, "a b a b a b a b a b a b")]
    items.append((25, items[0][1]))
    docs = []
    for i in range(120):
        text = say(rng.choice([0, 1, 5, 40, 200]))
        if rng.random() < 0.6:
            w = words(rng.choice(items)[1])
            a = rng.randrange(0, max(1, len(w) - 8))
            cut = rng.randrange(0, len(text) + 1)
            text = text[:cut] + w[a : a + rng.randrange(8, 20)] + text[cut:]
        docs.append((i, rng.choice([" ", ", ", ". \n"]).join(text).upper() if rng.random() < 0.3 else " ".join(text)))
    return docs + [(900, None), (901, ""), (902, "a b " * 9), (903, docs[3][1]), (903, docs[3][1])], items


@pytest.mark.parametrize("part_words", [1 << 20, 25])
def test_hits_against_brute_force(spark, monkeypatch, part_words):
    monkeypatch.setattr(d, "PART_WORDS", part_words)
    docs, items = rows()
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS hits", "doc_id AS items", "'k' AS keep")
    out = d.hits(docs_df, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted((r.doc_id, r.n_words, sum(x.end - x.begin for x in r["hits"]), r["items"]) for r in out)
    assert got == sorted((k, *brute(t, items)) for k, t in docs)
    assert all(r.keep == "k" for r in out)
    for r in out:
        assert all(a.end < b.begin for a, b in zip(r["hits"], r["hits"][1:], strict=False))


def test_automata_are_bounded_by_their_words():
    rng = random.Random(3)
    made = []
    for n in (2_000, 16_000):
        items = [np.array([rng.randrange(30) for _ in range(100)], dtype=np.uint64) for _ in range(n // 100)] + [np.arange(5, dtype=np.uint64)] * (n // 100)
        automaton = d.Automaton(items, 10)
        assert automaton.size() <= d.ROOM * sum(map(len, items))
        made.append(automaton.size() / sum(map(len, items)))
    assert made[1] < 1.5 * made[0]


@pytest.mark.parametrize("part_words", [1 << 18, 40])
def test_long_items_string_ids_and_clashing_names(spark, monkeypatch, part_words):
    monkeypatch.setattr(d, "PART_WORDS", part_words)
    rng = random.Random(4)
    long = " ".join(f"v{rng.randrange(50)}" for _ in range(150))
    items = [("b", long), ("a", "x1 x2 x3"), ("aa", long[: len(long) // 2]), (None, "zz"), ("dup", "x1 x2 x3"), ("dup", "x1 x2 x3")]
    w = long.split()
    docs = [(1, " ".join(["q"] * 5 + w[30:75] + ["q"])), (2, "X1, x2; x3 zz"), (3, " ".join(w[:9])), (4, "q " * 50_000 + " ".join(w[100:112])), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS _row", "'i' AS items", "2 AS n_words")
    for r in d.hits(df, spark.createDataFrame(items, "item_id string, text string")).collect():
        want = brute(dict(docs)[r.doc_id], items)
        assert (r.n_words, sum(x.end - x.begin for x in r["hits"]), r["items"]) == want and r._row == 1, r.doc_id


def test_cutting(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before. {item.upper()}, after that more words stay here and there to keep it below the limit of half"), (2, item), (3, "nothing to see"), (4, None)]
    out = d.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"))
    got = {r.doc_id: (r.text, r.n_cut, r.over_limit) for r in out.collect()}
    assert got[1] == ("Before. , after that more words stay here and there to keep it below the limit of half", 11, False)
    assert got[2] == ("", 11, True) and got[3] == ("nothing to see", 0, False) and got[4] == (None, 0, False)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r["hits"], r["items"]) for r in d.hits(docs, none).collect()] == [(2, [], [])]
    assert d.hits(docs.limit(0), none).count() == 0
