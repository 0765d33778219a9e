"""Queries over the driver's tables, one for each operator of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwell.llm.ngram_join import components

    return components(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""


#: The rules that the URL query is given.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwell.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwell.llm.bpe import default_ranks, encode

    done = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_ranks(), decoded=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwell.llm.pii import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), "a key for these queries only")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwell.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs, usable=~held_out)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwell.llm.line_dedup import site_line_dedup

    out = site_line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lines_dropped")


OP6_SQL = r"""
WITH lined AS (SELECT doc_id, source, text, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
counted AS (SELECT source, line, count(*) AS n FROM lined WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY ALL),
total AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
common AS (SELECT c.source, c.line FROM counted c JOIN total t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 5 AND n * 100 > pages * 5),
gone AS (SELECT l.doc_id, list(DISTINCT l.line) AS gone FROM lined l JOIN common c ON l.line = c.line AND l.source IS NOT DISTINCT FROM c.source GROUP BY l.doc_id),
kept AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines, [x FOR x IN string_split(d.text, chr(10)) IF NOT list_contains(g.gone, x)] AS kept, g.gone IS NOT NULL AS cut
  FROM documents d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id)
SELECT doc_id, CASE WHEN cut THEN coalesce(array_to_string(kept, chr(10)), '') ELSE text END AS text,
  CASE WHEN cut THEN len(lines) - len(kept) ELSE 0 END::BIGINT AS lines_dropped FROM kept
"""


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwell.llm.fertility import measure

    return measure(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwell.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwell.llm.decontaminate import hits, n_hit

    found = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
spots AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN sizes)),
met AS (SELECT doc_id, s.k, i, item_id FROM spots s JOIN win ON s.k = win.k AND s.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqwell.llm.chat import digests, prefix_targets

    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return digests(prefix_targets(rows))


OP10_SQL = r"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
sized AS (SELECT *, 32 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars,
  row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
  coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss, sum(upto) FILTER (role = 'assistant' OR k = n) AS formatted_chars FROM summed GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM whole
"""

QUERIES = {"op1_ngram_join": op1_ngram_join, "op2_url_filter": op2_url_filter, "op3_byte_bpe": op3_byte_bpe, "op4_pii": op4_pii, "op5_language_id": op5_language_id, "op6_line_dedup": op6_line_dedup, "op7_fertility": op7_fertility, "op8_toxicity": op8_toxicity, "op9_decontaminate": op9_decontaminate, "op10_chat_format": op10_chat_format}
ORACLES = {"op1_ngram_join": OP1_SQL, "op6_line_dedup": OP6_SQL, "op9_decontaminate": OP9_SQL, "op10_chat_format": OP10_SQL}
