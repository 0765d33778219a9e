"""Language ID, toxicity, URL filters, fertility: against definitions and held-out rows."""

import base64
import random
import re
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from seqwell.llm import bpe, fertility, langid, toxicity, url_filter
from seqwell.llm.words import arrow_bytes

SYLLABLES = {"aa": "ka to mi ne ru sha", "bb": "berg ung sch ein lich ö", "cc": "tion eau ment é aux qu"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_code_lengths_are_those_of_the_definition():
    rng = random.Random(1)
    texts = {k: [prose(rng, k, 30) for _ in range(3)] for k in SYLLABLES}
    scorer = langid.Scorer(langid.learn(texts))
    some = ["", "a", "ka to", "öön €", prose(rng, "cc", 20), "z" * 40, "kaé"]
    got = scorer.lengths(*arrow_bytes(pa.array(some, pa.large_string())))
    want = [[brute.code_length(texts[k], t, langid.ORDER) for k in sorted(texts)] for t in some]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_languages(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang, rng.randrange(5, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    odd = [(900, None, "aa"), (901, "", None), (902, "12 34 !?", "bb"), (903, prose(rng, "aa", 40), None), (903, prose(rng, "aa", 40), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'s' AS score", "1 AS lang_pred")
    out = langid.identify(docs, langid.fit(docs, usable=F.col("doc_id") % 3 != 5)).collect()
    said = {r.doc_id: r for r in out}
    assert sum(said[k].lang_pred == lang for k, _, lang in rows) >= 0.97 * len(rows)
    assert all(said[k].lang_pred == "und" and said[k].score == 0 and not said[k].accepted for k in (900, 901, 902))
    assert said[903].lang_pred == "aa" and len(out) == len(rows) + 5 and all(0 <= r.score <= 1 for r in out)
    assert langid.identify(docs.limit(0), langid.fit(docs)).count() == 0
    nothing = langid.identify(docs, langid.fit(docs.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_every_language_is_learnt(spark):
    rng = random.Random(5)
    long = [(i, prose(rng, "aa", 2500), "aa") for i in range(4)]
    assert all(len(t) > langid.LONGEST for _, t, _ in long)
    # all of one id, or of none
    short = [(None, prose(rng, "bb", 40), "bb") for _ in range(30)] + [(7, prose(rng, "cc", 40), "cc") for _ in range(30)]
    odd = [(100 + i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} " * 20, f"x{i:03}") for i in range(270)]
    docs = spark.createDataFrame(long + short + odd, "doc_id long, text string, lang string")
    models = langid.fit(docs)
    assert sorted(x for m in models for x in m.langs) == sorted({r[2] for r in long + short + odd})
    assert all(len(m.langs) <= langid.TABLE for m in models)
    assert all(r.lang_pred == r.lang and r.accepted for r in langid.identify(docs, models).collect())


def test_tables_do_not_change_code_lengths(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang, 30), f"{lang}{i % 2}") for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    # two languages of the same texts: the first by name
    rows += [(1000 + i, rows[i][1], f"a-{rows[i][2]}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many, small = (sorted(map(tuple, langid.identify(docs, langid.fit(docs, **k)).collect()), key=str) for k in ({"table": 100}, {"table": 1}, {"cells": 2000}))
    assert len(langid.fit(docs, cells=2000)) > 1 and one == many == small and all(r[3].startswith("a-") for r in one)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    bad = ["fool", "idiot", "scum"]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        words = prose(rng, rng.choice(list(SYLLABLES)), rng.randrange(20, 80)).split()
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad).upper()
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string").selectExpr("*", "'x' AS score")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, marks, usable=F.col("doc_id") % 4 != 2)).collect()}
    held = [(i, y) for i, y in labels if i % 4 == 2]
    assert np.mean([(out[i] >= 0.3) == bool(y) for i, y in held]) > 0.95
    assert out[900] == out[901] and 0 <= out[900] < 0.3
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).collect()} == {0.5}


def plain_ftrl(rows, labels, rate=1.0, beta=1.0, l1=15.0, l2=0.5, rounds=6, seed=7):
    """Weights by place and the bias, coordinate by coordinate."""
    z, n, order = Counter(), Counter(), np.random.Generator(np.random.PCG64(seed))

    def weight(k):
        if k != "bias" and abs(z[k]) <= l1:
            return 0.0
        shrunk = z[k] if k == "bias" else z[k] - (l1 if z[k] > 0 else -l1)
        return -shrunk / ((beta + n[k] ** 0.5) / rate + (0 if k == "bias" else l2))

    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            own = [*rows[i].tolist(), "bias"]
            w = {k: weight(k) for k in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[i]
            for k in own:
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / rate * w[k]
                n[k] += g * g
    return {k: weight(k) for k in z if weight(k)}


def test_weights_are_those_of_the_plain_version():
    rng = random.Random(8)
    texts = [prose(rng, "aa", 12) + (" fool and scum" if i % 3 == 0 else "") for i in range(150)]
    labels = np.array([float(i % 3 == 0) for i in range(150)])
    rows = toxicity._sparse(pa.array(texts))
    for text, own in zip(texts, rows, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        made = len({(x,) for x in w} | {(0, *x) for x in zip(w, w[1:], strict=False)} | {(1, *x) for x in zip(w, w[2:], strict=False)})
        assert made - 2 <= len(own) <= made  # places may fall together
    model, want = toxicity.ftrl(rows, labels), plain_ftrl(rows, labels)
    assert model.bias == pytest.approx(want.pop("bias")) and dict(zip(model.places.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want, rel=1e-5) and want


def test_toxicity_of_clashing_ids_and_bounds(spark):
    rows = [(i, "you fool and scum" if i % 2 else "a kind word") for i in range(40)] + [(2, "you are a scum"), (2, "other text"), (2, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0)], "doc_id long, toxic int")
    one, other = (toxicity.fit(d, marks) for d in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(5)))
    assert one.bias == other.bias and one.places.tolist() == other.places.tolist() and one.weights.tolist() == other.weights.tolist()
    empty = toxicity.fit(docs.limit(0), marks)
    assert empty.bias == 0 and not len(empty.places) and toxicity.score(docs.limit(0), empty).count() == 0
    assert toxicity.fit(docs, marks, most=1).bias != one.bias
    long = spark.createDataFrame([(1, "kind " * 200_000 + "fool")], "doc_id long, text string")
    assert 0 <= toxicity.score(long, one).first().score <= 1


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_urls(spark):
    urls = {
        "https://a.example.com/en/712?x#y": ("a.example.com", "/en/712", "example.com/en/7", "allow"),
        "http://A.Example.COM/en/8": ("a.example.com", "/en/8", "com/en/", "block"),
        "http://example.net/de/80": ("example.net", "/de/80", "example.net/de/8", "block"),
        "http://x.net/de/80": ("x.net", "/de/80", "net/de/", "allow"),
        "http://xcom/en/": ("xcom", "/en/", None, "allow"),
        "ftp://com/en/": ("com", "/en/", "com/en/", "block"),
        "https://free-bets.example.org/fr/1": ("free-bets.example.org", "/fr/1", None, "block"),
        "http://library.example.org?q=/es/": ("library.example.org", "", None, "allow"),
        "http://weather.example.org/a://b/c": ("weather.example.org", "/a://b/c", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(u, 1) for u in urls] + [(None, 2), (None, 2)], "url string, rule int")
    rows = url_filter.judge(pages, RULES).collect()
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in rows if r.url is not None} == urls
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows if r.url is None] == [("", "", None, "allow")] * 2
    with pytest.raises(ValueError):
        url_filter.train([("http://x/", 0)] * (url_filter.MOST_LABELLED + 1))


def test_url_model_does_not_know_the_hosts_of_the_tables(spark):
    known = {h for hosts in url_filter.LABELLED_HOSTS.values() for h in hosts.split()}
    hosts = [r.host for sf in ("sf0.001", "sf0.01", "sf0.1") for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select(url_filter.parts(F.col("url"))[0].alias("host")).distinct().collect()]
    assert hosts and not known & {x for h in hosts for x in h.split(".")}
    found = url_filter.held_out()
    assert {k: n for k, (n, _) in found.items()} == {k: len(v.split()) for k, v in url_filter.LABELLED_HOSTS.items()}
    assert found[1][1] >= 0.8 * found[1][0] and found[0][1] <= 0.15 * found[0][0]


def test_urls_of_the_whole_host(spark):
    w = url_filter.train()
    judged = lambda h: url_filter.probability(w, h, "/about") >= 0.5
    assert all(judged(h) for h in ("online-casino.com", "www.online-casino.com", "a.online-casino.com", "online-casino.pages.org", "m.online-casino.co.uk"))
    assert not any(judged(h) for h in ("library.com", "www.library.com", "a.library.com", "library.pages.org", "www.com"))
    # the same name counts alike wherever it stands, and by its place
    one, other = set(url_filter.grams("casino.com", "/").tolist()), set(url_filter.grams("casino.b.com", "/").tolist())
    assert len(one & other) >= 15 and one - other and other - one  # 6 + 5 + 4 n-grams of ^casino$


def test_url_rules_against_brute_force(spark):
    rng = random.Random(9)
    hosts = ["com", "a.com", "example.com", "x.example.com", "notexample.com", "net", "B.NET", "example.net", "org", "q.org", "xorg", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/8", "/en", "/de/", "/de/8", "/de/80", "/es/1", "/x/en/7"]
    urls = [f"{rng.choice(['http', 'ftp', 'x'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?/en/7', '#/de/', '?q://a'])}" for _ in range(400)]
    urls += [rng.choice(hosts) + rng.choice(paths) for _ in range(20)] + ["http://x.com/" + "a" * 200_000, "http://a.com\n/en/7"]
    pages = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, given int").selectExpr("*", "given AS _given", "1 AS row", "2 AS score")
    w = url_filter.train()
    for r in url_filter.judge(pages, RULES).collect():
        rest = r.url.split("://", 1)[1] if "://" in r.url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.lower()
        fitting = [(len(x), x, v) for v, x in RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[len(x.split("/")[0]) :])]
        assert (r.host, r.path) == (host, path) and r._given == r.given and r.row == 1
        if fitting:
            assert (r.rule, r.verdict, r.score) == (*max(fitting)[1:], None)
        else:
            p = url_filter.probability(w, host, "".join(c for c in path if not c.isdigit()))
            assert r.rule is None and r.score == pytest.approx(p) and r.verdict == ("block" if p >= 0.5 else "allow")
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def plain_script(text):
    raw = text.encode()
    if sum(b >= 0x80 for b in raw) * 3 < len(raw):
        return "latin"
    counts = Counter()
    for c in text:
        if ord(c) >= 0x41:
            counts[[name for start, name in fertility.SCRIPT_STARTS if start <= ord(c)][-1]] += 1
    return max({name for _, name in fertility.SCRIPT_STARTS}, key=lambda k: (counts[k], k))


def test_fertility(spark):
    rng = random.Random(4)
    texts = [prose(rng, "cc", n) for n in (10, 60, 300)] + ["a b c a b c", "x\n\nx\n x\ny", "### $$ \n", "日本語 テキスト " * 30, "\u00a0 a\u2003b", "слово и дело " * 25, "é" * 3000, "\U0001F600 " * 60, "the cat sat " * 40, "", None, " \n\t "]
    code = "\n".join(f"{' ' * 8 * (k % 4)}if x{k} == {k}:\n\t\ty{k} = 1\n\n" for k in range(60))
    some = sorted({w for _ in range(300) for w in prose(rng, "bb", 3).split()})
    texts += [code, " ".join(rng.sample(some, 120)), "A a A a A A a", "\n".join(" ".join(rng.choice("abc") for _ in range(5)) for _ in range(30)), " " * 250_000 + "x y", "the same line\n" * 3 + " ".join(some[:80])]
    texts.append(
        "The harbour was quiet when the ferry came in, and only two fishermen stood by the wall with their nets. A boy carried "
        "baskets of bread from the bakery to the hotel, counting his steps aloud. Later that morning rain moved over the hills, "
        "the market closed early, and people who had planned to swim went to the small museum instead, where an old clock told the wrong hour."
    )
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[1])], "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS entropy")
    with open(bpe.default_ranks(), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = fertility.measure(docs).collect()
    assert len(rows) == len(texts) + 1 and {r.kept for r in rows} == {True, False}
    for r in rows:
        text = texts[r.doc_id]
        assert tuple(r[c] for c in fertility.BASE) == base(text), text
        n, _, _, _, repeated = base(text)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        if not n:
            assert r.entropy is None and r.chars_per_piece is None and r.script is None and not r.kept
            continue
        ids, pairs = pieces.encode(text), library.encode_ordinary(text)
        share = np.array(list(Counter(ids).values())) / len(ids)
        entropy, byte_share = -(share * np.log2(share)).sum(), sum(pieces.is_byte(i) for i in ids) / len(ids)
        got = (r.chars_per_piece, r.chars_per_pair, r.byte_share, r.entropy)
        assert np.allclose(got, (len(text) / len(ids), len(text) / len(pairs), byte_share, entropy), atol=1e-9) and r.script == plain_script(text)
        (low, high), (low_pair, high_pair), most, least = fertility.BANDS[r.script]
        good = low <= got[0] <= high and low_pair <= got[1] <= high_pair and byte_share <= most
        good = good and (len(ids) < fertility.FEW or entropy >= least * np.log2(min(fertility.FULL, max(2, n))))
        assert r.kept == (good and not r.base_failed), text
    assert fertility.measure(docs.limit(0)).count() == 0
