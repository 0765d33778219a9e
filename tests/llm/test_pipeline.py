"""Every stage of the pipeline against a brute-force version, and the queries' registration."""

from collections import Counter

import brute
import corpus_pipeline
import test_decontaminate
import test_lines_and_chat
from pyspark.sql import functions as F

import __spark_entry__
from seqwell.llm import queries

ITEM = " ".join(f"bench{i}" for i in range(15))
LANGS = {"en": "the thing is that nation of here", "de": "der die ungen schlich einen ober"}


def documents():
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        body = " ".join(f"{w}{(i * 7 + k * k) % 31 if k % 3 else ''}" for k, w in enumerate(LANGS[lang].split() * 6))
        rows.append([i, f"site menu line\n{body}", lang, f"s{i % 2}", 0])
    rows[10][1] = rows[4][1] + " extra"
    rows[12][1] = rows[4][1]
    rows[20][1] += " " + ITEM
    rows += [[70, None, "en", "s0", 0], [71, "", None, None, 0], [72, "123 456", "en", "s1", 7], [73, ITEM, "en", "s9", 1]]
    return [tuple(r) for r in rows]


def test_run_against_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    lines = {k: t for k, t, _ in test_lines_and_chat.brute_lines([(r[0], r[1], r[3]) for r in kept])}
    first = {k: c for k, (_, c) in brute.components(list(lines.items())).items()}
    lines = {k: t for k, t in lines.items() if first[k] == k}
    hits = {k: test_decontaminate.brute(t, [(1, ITEM)]) for k, t in lines.items()}
    lines = {k: t for k, t in lines.items() if hits[k][1] * 2 <= hits[k][0]}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(lines) and all(r.round_trip for r in out)
    assert 10 not in lines and 12 not in lines and 73 not in lines and 20 in lines


def test_stage_columns_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (k == 4 or out.columns == corpus_pipeline.COLUMNS)


def test_join_keeps_one_document_a_group_whatever_the_ids(spark):
    texts = [" ".join(f"{w}{k}" for k in range(40)) for w in "abcdefg"]
    rows = [
        (None, texts[0]),  # null and alone
        (None, texts[1]), (None, texts[1]), (None, texts[1] + " more"),  # a group of null ids only
        (7, texts[2]), (7, texts[3]),  # two texts under one id
        (8, texts[4]), (None, texts[4]), (5, texts[4] + " more"),  # the smallest id stays, not the null one
        (9, texts[5]), (9, texts[5] + " more"), (None, None), (None, ""), (3, None), (3, None),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_join(spark, docs.repartition(3), "").collect()]
    again = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_join(spark, docs.orderBy(F.desc("text")).coalesce(1), "").collect()]
    single = [(None, texts[0]), (7, texts[2]), (7, texts[3]), (5, texts[4] + " more"), (None, None), (None, ""), (3, None), (3, None)]
    own = lambda w: [x for x in kept if (x[1] or "").startswith(w)]
    assert all(kept.count(x) == single.count(x) for x in single) and len(kept) == len(single) + 2
    assert len(own(texts[1])) == 1 and own(texts[1])[0][0] is None and len(own(texts[5])) == 1 and own(texts[5])[0][0] == 9
    assert Counter(kept) == Counter(again)


def test_registration():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)
