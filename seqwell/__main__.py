"""python -m seqwell STORE "STATEMENTS": runs statements; elements come as JSON lines on stdin, results go as JSON lines to stdout."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession

from seqwell.plans.language import execute, parse
from seqwell.sources.store import Store


def main(args: list[str], source=sys.stdin, out=sys.stdout, spark: SparkSession | None = None) -> int:
    if len(args) != 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("seqwell").getOrCreate()
    wanted = [s for s in parse(args[1]) if getattr(s, "verb", "") in ("insert", "write")]
    rows = [json.loads(x) for x in source if x.strip()] if wanted else []
    failed = 0
    for r in execute(Store(spark, args[0]), args[1], {s.name: rows for s in wanted}):
        if r.error is not None:
            failed += 1
            print(json.dumps({"error": type(r.error).__name__, "text": str(r.error)}), file=out)
        elif isinstance(r.value, DataFrame):
            for line in r.value.orderBy("pos").toJSON().toLocalIterator():
                print(line, file=out)
        else:
            print(json.dumps({r.statement.verb: r.statement.name, "result": r.value}), file=out)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
