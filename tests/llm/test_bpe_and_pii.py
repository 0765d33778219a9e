import base64
import random
import time

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from seqwell.llm import bpe, pii

TEXTS = ["", "hello world", "  \n\n x  ", "don't 've'll", "\x1c\x1d a\x85b\u3000c", "a" * 3000, "aA" * 400, " " * 300 + "b", "Ünïcødé 日本語 🎉 ١٢٣", "<|endoftext|>", "x" * 70 + "ab" * 60]


def test_encoding_is_that_of_the_library(spark):
    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab cdeéñ\n\t '…日\U0001F600ßio12.,") for _ in range(rng.randrange(80))) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "twice"), (-2, "twice")], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded")
    out = bpe.decode(bpe.encode(docs, bpe.default_ranks()), bpe.default_ranks()).collect()
    for r in out:
        text = r.text or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert len(out) == len(texts) + 3
    at_once = bpe.encode(docs, bpe.default_ranks(), decoded=True)
    assert sorted(map(str, at_once.collect())) == sorted(map(str, out)) and at_once.columns == ["doc_id", "text", "ids", "decoded"]


def test_vocabulary():
    v = bpe.Vocabulary(bpe.default_ranks())
    with pytest.raises(ValueError):
        v.decode(np.array([v.size]))
    piece = b"abcabcabc" * 7
    assert v.merge_rows([piece])[0].tolist() == v.merge_long(piece).tolist()


PII = {
    "card 4111 1111 1111 1111.": {"n_card": 1}, "4111111111111111 and 4111111111111112": {"n_card": 1}, "3782-822463-10005": {"n_card": 1},
    "mail thé.27@mail3.example.com, now": {"n_email": 1}, "at 233.254.104.120. and 999.1.1.1": {"n_ip": 1}, "born 1987-02-28": {"n_date": 1}, "on 31.12.1999 or 12/31/1999": {"n_date": 2},
    "2023-02-30 is no day": {}, "ssn 123-45-6789, 666-12-1234, 000-12-1234": {"n_ssn": 1}, "call +1 (487) 555-7209 or +49 30 1234 5678": {"n_phone": 2}, "iban GB82 WEST 1234 5698 7654 32": {"n_iban": 1},
    "GB82 WEST 1234 5698 7654 33": {}, "token b44e15e09fd311c3cf3163b66d5a9875b883d8ce": {}, "nothing": {}, "": {}, "12 @ 3.5": {}, "call 555-123-4567 or (555) 123-4567, 0171 1234 567, not 1-555-123-4567 or 155-123-4567": {"n_phone": 3},
    "γιώργος.π@mail.example and почта7@mail.example": {"n_email": 2}, "._%@x.example": {}, "a" * 65 + "@x.example": {}, "05/13/1999 and 13.13.1999 and 01/02/1599": {"n_date": 1},
}


def test_pseudonyms(spark):
    texts = list(PII)
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string").selectExpr("*", "9 AS n_card", "'q' AS found", "1 AS row")
    out = pii.pseudonymised(docs, "key")
    rows = {r.doc_id: r for r in out.collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert {f"n_{k}": r[f"n_{k}"] for k in pii.KINDS if r[f"n_{k}"]} == PII[text], text
        assert (r.text == text) == (not PII[text]) and len(r.text) - len(text) in range(-9, 9) and r.found == "q" and r.row == 1
    assert rows[-1].text is None
    # the format holds: the same finds again, and another key gives other pseudonyms, the same key the same
    again = {r.doc_id: r for r in pii.pseudonymised(out, "key").collect()}
    assert all(all(again[i][f"n_{k}"] == rows[i][f"n_{k}"] for k in pii.KINDS) for i in rows)
    other = {r.doc_id: r.text for r in pii.pseudonymised(docs, "other").collect()}
    same = {r.doc_id: r.text for r in pii.pseudonymised(docs.repartition(3), "key").collect()}
    assert all(same[i] == rows[i].text and (not PII[t] or other[i] != rows[i].text) for i, t in enumerate(texts))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pseudonyms_are_those_of_the_plain_version(spark):
    rng = random.Random(8)
    some = [" and ".join(rng.sample(list(PII), 3)) for _ in range(60)]
    some += [f"{rng.randrange(400)}.{rng.randrange(300)}.1.{i} {rng.randrange(1500, 2500)}-{rng.randrange(14):02d}-{rng.randrange(32):02d} {rng.randrange(1000):03d}-{rng.randrange(100):02d}-{rng.randrange(9999):04d} x{i}@a.b {rng.randrange(10**15, 10**16)}" for i in range(100)]
    rows = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), "key").collect()}
    for i, text in enumerate(some):
        want, counts = brute.pseudonymised(text, "key", pii.ANY, pii.CLASSES)
        assert rows[i].text == want, text
        assert {k: rows[i][f"n_{k}"] for k in pii.KINDS if rows[i][f"n_{k}"]} == counts
    said = {i: brute.pseudonymised(t, "key", pii.ANY, pii.CLASSES)[0] for i, t in enumerate(some)}
    assert sum(said[i] != some[i] for i in said) > 100


def test_long_texts_take_linear_time_and_no_stack(spark):
    long = {0: "a@b" + ".c" * 20_000, 1: "1" + "x" * 1_000_000, 2: "1.1.1." * 170_000, 3: "1 " + "a.b-" * 250_000 + "@", 4: "9" * 1_000_000, 5: "7 " + "A" * 1_000_000 + "1", 6: "me@x.example " * 3000}
    docs = spark.createDataFrame(list(long.items()), "doc_id long, text string")
    for i, text in long.items():
        began = time.perf_counter()
        r = pii.pseudonymised(docs.where(F.col("doc_id") == i), "key").first()
        assert time.perf_counter() - began < 10, i
        assert r.n_email == {0: 1, 6: 3000}.get(i, 0) and len(r.text) == len(text) and (i in (0, 6) or r.text == text)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a.b@x.example"), (1, "a.b@x.example"), (None, None)], "doc_id long, text string")
    rows = [r.text for r in pii.pseudonymised(docs, "key").collect()]
    assert rows[0] == rows[1] != "a.b@x.example" and rows[2] is None
    assert pii.pseudonymised(docs.limit(0), "key").count() == 0
    nothing = bpe.decode(bpe.encode(docs.limit(0), bpe.default_ranks()), bpe.default_ranks())
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "text", "ids", "decoded"]


def test_linkage_and_bijection(spark):
    docs = spark.createDataFrame([(i, f"a 10.0.{i // 200}.{i % 200} b {1900 + i % 100}-01-{1 + i % 28:02d} c") for i in range(600)] + [(600, "10.0.0.0")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in pii.pseudonymised(docs, "k").collect()}
    assert len({rows[i].split()[1] for i in range(600)}) == 600 and rows[600] == rows[0].split()[1]
    small = spark.range(12 * 7).select(pii.product((F.col("id") / 7).cast("long"), F.col("id") % 7, 12, 7, "k", "x").alias("p"))
    assert small.distinct().count() == 84
    every = spark.range(1000).select(pii.characters(F.format_string("%03d", "id"), "k", "x").alias("p"))
    assert every.distinct().count() == 1000 and every.where("NOT p RLIKE '^[0-9]{3}$'").count() == 0
