"""Near-duplicate join of documents on the Jaccard similarity of their word n-grams, by vertical partitioning.

The n-grams are counted and put in one global order: by the power of two that their number of texts reaches, the rare ones
first, then by hash. That order is cut into fragments where the power of two changes; each text's n-grams, in this order,
fall into one segment a fragment. Pairs of texts that share one of their rarest n-grams, without one of which no pair can
be similar enough, are candidates; for each of them every fragment counts the overlap of the two segments separately, and
the sums per pair decide, by integers. N-grams of a single text cannot be shared, so they go once they are counted, and a
text with too many of them has no partner and goes too. N-grams are known by 64 bits throughout.

How hot groups are met:

* Copies. Texts of one n-gram set are one class, known by a hash of the set; copies are dropped before the shuffle where
  they meet in a block and are counted once where n-grams are counted. Classes join, not documents.
* Very common n-grams (in one of `COMMON` texts or more). Each text has few distinct ones on average, so there are at most
  COMMON x (mean n-grams a text) of them: that bound makes the table of them fit a broadcast. They are not counted again;
  they are the last fragment of the global order.
* Large groups of near copies. Members of a key's bucket are tried against one leader first. Members found to be connected
  already need no further test, so a group of m near copies takes about m pairs, not m * m / 2. A pair's first key bounds
  its overlap by what both have from there on; members that this parts from all others leave the bucket. A bucket that still
  holds several components gets `GROWTH` times as many leaders in the next round, drawn by a hash of the class, which have
  met every member then and leave; so all pairs across components are decided after a logarithm of the bucket's size of
  rounds, and no round lists more than its leaders times the members left. No bucket or partner is capped, and the
  components are those of all links.
* Hot keys of joins. The keys with one of `COMMON` rows or more, at most COMMON of them, are found first; their rows are
  dealt over as many tasks as it takes by a second key, to which the other side is copied.

Defined results: null or empty texts, and texts without words, have no n-gram, are linked with nothing and are a component
of their own; a text of fewer words than n is one n-gram; repeated rows and equal texts are one component; very long texts
are taken whole; a null doc_id takes part but never names a component; ids may be numbers or strings, the smallest names
the component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqwell.llm import shared
from seqwell.llm.words import SPACED, blocks, mixed, tidy, trimmed, windows

#: An n-gram is common if one of so many texts has it, a key of a join hot if one of so many rows has it.
COMMON = 500
#: N-grams that are counted in a task on average at most, and that a block of texts gathers before it is dealt to the tasks.
COUNTED, GATHER = 1 << 21, 1 << 19
#: Leaders of a bucket in the round after the first one, and how many times more each further round has.
LEADERS, GROWTH = 16, 16
#: The fragment of common n-grams, the last of the global order.
LAST = 255


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct n-gram hashes of each text."""
    for block in blocks(texts, SPACED):
        found, begin = windows(block.hashes(), block.at, n)
        for i in range(block.n):
            own = np.sort(found[begin[i] : begin[i + 1]])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield block.first + i, own


def _class(own: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    total = mixed(own ^ np.uint64(0xA5A5_5A5A_0F0F_F0F0)).sum(dtype=np.uint64) + np.uint64(len(own))
    return int(mixed(np.array([total]))[0].astype(np.int64))


def _survey(n: int, key):
    """Of each document its class and the size of its set; of each block the n-grams that are common in it. key: the type of ids."""
    own_key = to_arrow_type(key)
    kinds = pa.schema([("doc_id", own_key), ("size", pa.int64()), ("class", pa.int64()), ("ngram", pa.int64()), ("texts", pa.int64())])

    def told(gathered: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(gathered))
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        count = np.diff(np.concatenate([first, [len(every)]]))
        often = count >= max(3, len(gathered) / (2 * COMMON))
        some = pa.nulls(int(often.sum()), pa.int64())
        return pa.record_batch([pa.nulls(len(some), own_key), some, some, pa.array(every[first[often]].view(np.int64)), pa.array(count[often].astype(np.int64))], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, seen, held = [], set(), 0
        for batch in batches:
            size, name = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for i, own in _sets(batch.column(1), n):
                size[i] = len(own)
                if len(own):
                    name[i] = _class(own)
                    if name[i] not in seen:
                        seen.add(name[i])
                        gathered.append(own)
                        held += len(own)
                if held >= GATHER:
                    yield told(gathered)
                    gathered, seen, held = [], set(), 0
            none = pa.nulls(len(batch), pa.int64())
            yield pa.record_batch([batch.column(0), pa.array(size), pa.array(name, mask=size == 0), none, none], schema=kinds)
        if gathered:
            yield told(gathered)

    return tidy(run), f"doc_id {key.simpleString()}, size long, class long, ngram long, texts long"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, all lowest bytes first, then the next ones: the high ones are zeros and take no room in a shuffle."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _deal(n: int, bits: int, common):
    """Deals the n-grams of each block of texts to 2 ** bits counting tasks: a row per block and task, packed. Common ones go to rows of negative tasks."""
    kinds = pa.schema([("task", pa.int32()), ("classes", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])

    def dealt(names: list[int], sizes: list[int], sets: list[np.ndarray], turn: int) -> Iterator[pa.RecordBatch]:
        gram = np.concatenate(sets)
        text = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        known = common.value
        task = (gram >> np.uint64(64 - bits)).astype(np.int32)
        if len(known):
            often = known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram
            task[often] = -1 - turn % (1 << bits)
        order = np.argsort(task, kind="stable")
        task, gram, text = task[order], gram[order], text[order]
        run = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (text[1:] != text[:-1])]))
        length = np.diff(np.concatenate([run, [len(text)]]))
        of, name, size = task[run], np.array(names, dtype=np.int64)[text[run]], np.array(sizes, dtype=np.int64)[text[run]]
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        ends = np.concatenate([cut[1:], [len(of)]])
        rows = [(int(of[a]), name[a:b].tobytes(), _planes(size[a:b]), _planes(length[a:b]), gram[run[a] : run[b] if b < len(run) else len(gram)].tobytes()) for a, b in zip(cut, ends, strict=True)]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, sets, seen, held, turn = [], [], [], set(), 0, 0
        for batch in batches:
            for _, own in _sets(batch.column(0), n):
                if not len(own) or (name := _class(own)) in seen:
                    continue
                turn = turn or name % 1009
                seen.add(name)
                names.append(name)
                sizes.append(len(own))
                sets.append(own)
                held += len(own)
                if held >= GATHER:
                    yield from dealt(names, sizes, sets, turn)
                    names, sizes, sets, seen, held, turn = [], [], [], set(), 0, turn + 1
        if sets:
            yield from dealt(names, sizes, sets, turn)

    return tidy(run), "task int, classes binary, sizes binary, counts binary, grams binary"


_SHARED = pa.schema([("class", pa.int64()), ("size", pa.int64()), ("grams", pa.binary()), ("fragments", pa.binary())])


def _counted(key: tuple, rows: pa.Table) -> pa.Table:
    try:
        return _count(key, rows)
    finally:
        trimmed()


def _count(key: tuple, rows: pa.Table) -> pa.Table:
    """The n-grams of a task that several classes have, by class, each with its fragment: the power of two that its number of classes reaches."""
    common = key[0].as_py() < 0
    put = lambda c: [x.as_buffer() for x in rows.column(c)]
    names = [np.frombuffer(x, dtype=np.int64) for x in put("classes")]
    sizes, counts = ([_from_planes(x).astype(np.int64) for x in put(c)] for c in ("sizes", "counts"))
    # a class has one run in each row, and all of them are alike: the first one is kept
    once = np.zeros(sum(map(len, names)), dtype=bool)
    once[np.unique(np.concatenate(names), return_index=True)[1]] = True
    kept = np.split(once, np.cumsum([len(x) for x in names])[:-1])
    gram = np.concatenate([np.frombuffer(x, dtype=np.uint64)[np.repeat(k, c)] for x, k, c in zip(put("grams"), kept, counts, strict=True)])
    name, size, count = (np.concatenate(x)[once] for x in (names, sizes, counts))
    if common:
        fragment = np.full(len(gram), LAST, dtype=np.uint8)
    else:
        order = np.argsort(gram)
        ranked = gram[order]
        same = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
        # most n-grams are of one class; the others, each with its number of classes
        several = same[1:] | same[:-1]
        order, ranked = order[several], ranked[several]
        start = np.flatnonzero(~same[:-1][several])
        classes = np.diff(np.concatenate([start, [len(ranked)]]))
        fragment = np.zeros(len(gram), dtype=np.uint8)
        fragment[order] = np.repeat(np.frexp(classes - 0.5)[1].astype(np.uint8), classes)
        del order, ranked, several, same
        several = fragment > 0
        count = np.add.reduceat(several, np.cumsum(count) - count, dtype=np.int64)
        gram, fragment = gram[several], fragment[several]
        some = count > 0
        name, size, count = name[some], size[some], count[some]
    ends = np.cumsum(count)
    spans = list(zip((ends - count).tolist(), ends.tolist(), strict=True))
    return pa.table([pa.array(name), pa.array(size), pa.array([gram[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([fragment[a:b].tobytes() for a, b in spans], pa.binary())], schema=_SHARED)


def _ordered(percent: int):
    """Of each class that can have a partner: its shared n-grams in the global order, a segment a fragment, and how many of them are its prefix, the rarest ones.

    The mass says how common a text's n-grams are on average: the text that others were made from has the most."""
    segment = pa.struct([("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))])
    kinds = pa.schema([("class", pa.int64()), ("size", pa.int64()), ("mass", pa.float64()), ("shared", pa.int32()), ("prefix", pa.int32()), ("segments", pa.list_(segment))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, len(b), 1000)):
            out: tuple[list, ...] = ([], [], [], [], [])
            cut, of, lengths, grams = [0], [], [0], []
            for name, size, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                gram = np.concatenate([np.frombuffer(x["grams"], dtype=np.uint64) for x in parts])
                fragment = np.concatenate([np.frombuffer(x["fragments"], dtype=np.uint8) for x in parts])
                order = np.lexsort((gram, fragment))
                gram, fragment = gram[order], fragment[order]
                # common n-grams come from each block that the class is in
                again = np.concatenate([[False], (gram[1:] == gram[:-1]) & (fragment[1:] == fragment[:-1])])
                gram, fragment = gram[~again], fragment[~again]
                prefix = size - -(-percent * size // 100) + 1 - (size - len(gram))
                if prefix <= 0:
                    continue
                begin = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
                for x, y in zip(out, (name, size, float(np.exp2(np.minimum(fragment, 30.0)).sum()) / size, len(gram), prefix), strict=True):
                    x.append(y)
                of.append(fragment[begin].astype(np.int32))
                lengths += np.diff(np.concatenate([begin, [len(gram)]])).tolist()
                grams.append(gram.view(np.int64))
                cut.append(cut[-1] + len(begin))
            none = [np.zeros(0, dtype=np.int64)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(np.concatenate(none + grams)))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(none + of).astype(np.int32)), lists], fields=list(segment))
            yield pa.record_batch([*(pa.array(x, t) for x, t in zip(out, kinds.types[:5], strict=True)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), flat)], schema=kinds)

    return tidy(run), "class long, size long, mass double, shared int, prefix int, segments array<struct<fragment:int,grams:array<long>>>"


def _power(n: int) -> int:
    """The power of two from n on. A number of its own in every plan would be compiled anew each time, and executors keep what is compiled."""
    return 1 << max(0, n - 1).bit_length()


def met(rows: DataFrame, other: DataFrame, key: str, by: Column | str, how: str = "inner") -> DataFrame:
    """`rows` joined on `key` with `other`. Rows of a hot key are dealt by `by` over several tasks, and what `other` has for it is copied to each.

    `rows` is read three times, so it should be a written table; hot keys are COMMON at most, and are broadcast."""
    total = _power(rows.count())
    many = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * COMMON >= total)
    hot = F.broadcast(many.select(key, F.least("_n", F.ceil(F.col("_n") * COMMON / total)).cast("int").alias("_tasks")))
    tasks = F.coalesce("_tasks", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_at", F.pmod(F.xxhash64(by, F.lit("task")), tasks).cast("int")).drop("_tasks")
    copied = other.join(hot, key, "left").withColumn("_at", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("_tasks")
    return dealt.join(copied, [key, "_at"], how).drop("_at")


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose similarity is `percent` at least: each fragment counts its overlap, and the sums decide."""
    of_a = segments.select(F.col("class").alias("a"), "fragment", F.col("grams").alias("of_a"), F.col("size").alias("size_a"))
    one = met(pairs, of_a, "a", "b")
    both = one.join(segments.select(F.col("class").alias("b"), "fragment", F.col("grams").alias("of_b"), F.col("size").alias("size_b")), ["b", "fragment"])
    partial = both.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("of_a", "of_b")).alias("overlap"))
    total = partial.groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.sum("overlap").alias("overlap"))
    return total.where(F.col("overlap") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("overlap")) * percent).select("a", "b")


def connected(edges: DataFrame, tables: shared.Tables | None = None) -> DataFrame:
    """The smallest node of each node's component, (node, root), by rounds of large and small stars over written tables."""
    tables = tables or shared.Tables(edges.sparkSession)
    edges = tables.written(edges.where("a <> b").select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")).distinct())
    while True:
        # large star: every larger neighbour of a node is linked with the node's smallest neighbour
        near = edges.unionByName(edges.select(F.col("node").alias("root"), F.col("root").alias("node")))
        least = near.groupBy("root").agg(F.min("node").alias("m")).select("root", F.least("root", "m").alias("m"))
        large = tables.written(met(near, least, "root", "node").where("node > root").select(F.col("m").alias("root"), "node").distinct())
        # small star: the smaller neighbours of a node are linked with the smallest of them
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        small = met(large, low, "node", "root").where("root <> m").select(F.col("m").alias("root"), F.col("root").alias("node"))
        edges = tables.written(small.unionByName(low.select(F.col("m").alias("root"), "node")).distinct())
        # done when no node has two roots and no root is a node
        ends = edges.select("node", F.lit(1).alias("up")).unionByName(edges.select(F.col("root").alias("node"), F.lit(1 << 20).alias("up")).distinct())
        if ends.groupBy("node").agg(F.sum("up").alias("up")).where(f"up NOT IN (1, {1 << 20})").isEmpty():
            return edges


def _rounds(classes: DataFrame, percent: int, tables: shared.Tables) -> DataFrame:
    """(node, root) of all classes that are linked with another."""
    segments = classes.select("class", "size", F.explode("segments").alias("s")).select("class", "size", "s.fragment", "s.grams")
    # if a key is the first that a pair has in common, its overlap is at most what either has from there on, so a partner's
    # set has at most `reach` n-grams: overlap >= percent / (100 + percent) * (sum of both sizes)
    own = F.slice(F.flatten(F.transform("segments", lambda s: s["grams"])), F.lit(1), F.col("prefix"))
    every = classes.select("class", "size", "mass", "shared", F.posexplode(own).alias("before", "gram"))
    reach = F.floor((100 + percent) * (F.col("shared") - F.col("before")) / percent) - F.col("size")
    every = every.select("gram", "class", "size", "mass", reach.alias("reach"))
    # of each bucket of several members the one of most mass as leader, and those members that some size in it can go with
    lead = F.max_by(F.struct(F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("reach").alias("reach_a")), F.struct("mass", "class"))
    bucket = every.groupBy("gram").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("reach").alias("most"), lead.alias("lead")).where("n > 1")
    keys = met(every.drop("mass"), bucket, "gram", "class").where((F.col("reach") >= F.col("least")) & (F.col("size") <= F.col("most")))
    keys = tables.written(keys.select("gram", "class", "size", "reach", "n", "lead.*"))

    alike = (F.col("size_a") <= F.col("reach_b")) & (F.col("size_b") <= F.col("reach_a"))
    as_b = [F.col("class").alias("b"), F.col("size").alias("size_b"), F.col("reach").alias("reach_b")]
    pairs = keys.where("class <> a").select("a", "size_a", "reach_a", *as_b).where(alike).select("a", "b").distinct()
    total, roots, leaders, before = _power(keys.count()), None, LEADERS, 0
    # a bucket's rows are dealt over tasks by its number of members, which both sides of a join know
    tasks = F.greatest(F.lit(1), F.ceil(F.col("n") * COMMON / total)).cast("int")
    dealt = F.pmod(F.xxhash64("class", F.lit("task")), tasks).cast("int").alias("at")
    copied = F.explode(F.sequence(F.lit(0), tasks - 1)).alias("at")
    turn = F.pmod(F.xxhash64("class", F.lit("turn")), F.lit(1 << 53)) / (1 << 53) * F.col("n")
    while True:
        found = tables.written(_linked(tables.written(pairs), segments, percent))
        roots = connected(found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), tables)
        # those that have not led their bucket yet, if others of another component are there
        named = met(keys, roots.withColumnRenamed("node", "class"), "class", "gram", "left").withColumn("root", F.coalesce("root", "class"))
        named = tables.written(named.select("gram", "class", "size", "reach", "n", "root").where(turn >= before))
        several = named.groupBy("gram").agg(F.max("n").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        open_ = tables.written(named.select("*", dealt).join(several.select("gram", copied), ["gram", "at"], "left_semi").drop("at"))
        if open_.isEmpty():
            return roots
        as_a = [F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("reach").alias("reach_a"), F.col("root").alias("root_a")]
        first = open_.where(turn < leaders).select("gram", *as_a, copied)
        pairs = open_.select("gram", *as_b, F.col("root").alias("root_b"), dealt).join(first, ["gram", "at"]).where(alike & (F.col("root_a") != F.col("root_b")))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        before, leaders = leaders, leaders * GROWTH


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`; texts are linked from a similarity of `percent` on."""
    spark = docs.sparkSession
    tables = shared.Tables(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    survey = tables.written(rows.mapInArrow(*_survey(n, rows.schema["doc_id"].dataType)))
    known = survey.where("ngram IS NULL").select("doc_id", "size", "class")
    texts, grams = known.agg(F.count("class"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # at most COMMON * (n-grams a text) rows, as said above
    often = survey.where("ngram IS NOT NULL").groupBy("ngram").agg(F.sum("texts").alias("texts")).where(F.col("texts") * COMMON >= texts).select("ngram").toPandas()
    common = spark.sparkContext.broadcast(np.sort(often["ngram"].to_numpy(np.int64).view(np.uint64)))

    bits = max(6, int(np.ceil(np.log2(max(1, grams) / COUNTED))))
    dealt = rows.select("text").mapInArrow(*_deal(n, bits, common))
    held = dealt.groupBy("task").applyInArrow(_counted, "class long, size long, grams binary, fragments binary")
    whole = held.groupBy("class").agg(F.max("size").alias("size"), F.collect_list(F.struct("grams", "fragments")).alias("parts"))
    classes = tables.written(whole.mapInArrow(*_ordered(percent)))
    roots = _rounds(classes, percent, tables)

    by_class = known.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"))
    by_class = tables.written(by_class.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")))
    least = by_class.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = tables.written(met(by_class, least, "root", "class").select("class", "component_id"))
    out = met(known, by_class, "class", F.monotonically_increasing_id(), "left")
    out = tables.written(out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
    tables.keep(out)
    return out
