import hashlib
from collections import Counter, defaultdict

from seqwell.llm.chat import digests, escaped, prefix_targets, turns_of, unescaped
from seqwell.llm.line_dedup import site_line_dedup


def brute_lines(rows, percent=5, least=5):
    pages, holders = Counter(), defaultdict(int)
    for _, text, site in rows:
        pages[site] += 1
        for line in set((text or "").split("\n")):
            if line.strip(" \t\r"):
                holders[site, line] += 1
    bad = {k for k, n in holders.items() if n >= least and n * 100 > pages[k[0]] * percent}
    out = []
    for key, text, site in rows:
        lines = None if text is None else text.split("\n")
        kept = None if text is None else [x for x in lines if (site, x) not in bad]
        out.append((key, None if text is None else "\n".join(kept), 0 if text is None else len(lines) - len(kept)))
    return out


def test_lines_against_brute_force(spark):
    rows = [(i, f"menu\nbody {i}\n\n{'rare' if i < 4 else 'foot'}\nmenu", ["a", "b", None][i % 3]) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "a"), (102, "menu", "a"), (103, "menu", "c"), (104, " \n\t\n ", "a"), (105, "menu\nx", "a"), (105, "menu\nx", "a"), (None, "foot\nlast", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = docs.selectExpr("*", "1 AS lines_dropped", "'g' AS _gone", "2 AS _k", "3 AS _id", "4 AS row")
    out = site_line_dedup(clash)
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.doc_id, r.text, r.lines_dropped) for r in out.collect()), key=key) == sorted(brute_lines(rows), key=key)
    assert out.columns == ["doc_id", "text", "source", "_gone", "_k", "_id", "row", "lines_dropped"]
    assert out.where("_gone = 'g' AND row = 4").count() == len(rows)
    assert site_line_dedup(docs.limit(0)).count() == 0


def test_hot_and_cold_sites_against_brute_force(spark):
    # one site has a third of all pages, a line of it is on all of them; 1,400 small sites are below the share of a hot one
    rows = [(i, f"hot menu\nrow {i % 40}\nx{i}", "hot") for i in range(900)]
    rows += [(1000 + i, f"menu\nfoot {i // 7 % 2}\n{'hot menu' if i % 3 else i}", f"s{i // 7 if i < 700 else i}") for i in range(2000)]
    rows += [(5000, "hot menu\n" * 30_000 + "end", "hot"), (5001, "\n".join(f"l{k}" for k in range(30_000)), "s1")]
    out = site_line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    assert sorted((r.doc_id, r.text, r.lines_dropped) for r in out.collect()) == sorted(brute_lines(rows))


def test_native_plans(spark):
    docs = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, source string")
    talks = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for out in (site_line_dedup(docs), digests(prefix_targets(talks))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


ROWS = [
    (1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "hi \\ <|"), (1, 2, "assistant", "yo\n<|im_sep|>"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
    (2, 0, "user", "alone"), (3, 0, "assistant", "first"), (None, 0, "assistant", "null key"), (4, 0, None, "no role"), (4, 0, None, "no role"), (5, None, "assistant", "b"), (5, 1, "assistant", "\\<\\|\\\\|"), (6, 0, "us\ner<|im_sep|>", "odd role \U0001F600"),
]


def test_chat_round_trip(spark):
    talks = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS t", "2 AS example", "3 AS formatted")
    examples = prefix_targets(talks)
    by = defaultdict(list)
    for r in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[r[0]].append((r[2] or "", r[3] or ""))
    for r in digests(examples).collect():
        turns = by[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    counts = Counter(r.conv_id for r in examples.collect())
    assert counts == {1: 3, 2: 1, 3: 1, None: 1, 4: 1, 5: 2, 6: 1}
    for r in examples.withColumn("turns", turns_of(examples.formatted)).collect():
        assert len(r.turns) == r.n_turns and [tuple(x) for x in r.turns] == by[r.conv_id][: r.n_turns]
        assert 0 <= r.loss_start <= r.loss_end <= len(r.formatted)


def test_escapes(spark):
    texts = ["", "\\", "<|", "<\\|", "\\<|", "\\\\<|\\", "<|im_start|>a<|im_sep|>", "a\nb", "<<||>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", escaped(df.t).alias("e"), unescaped(escaped(df.t)).alias("back")).collect()
    assert all(r.t == r.back and "<|" not in r.e for r in rows) and len({r.e for r in rows}) == len(texts)
    assert digests(prefix_targets(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
