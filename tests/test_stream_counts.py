"""Counts of a stream after any order of batches, and after a restart, are those of the newest chunks."""

import math
import random

from termweave.streaming import counts as C


def plain(rows):
    newest = {}
    for i, v, t in rows:
        newest[i] = max(newest.get(i, (-1, "")), (v, t or ""))
    frequency, documents = {}, {}
    for _, text in newest.values():
        for term, n in C.runs(text).items():
            frequency[term] = frequency.get(term, 0) + n
            documents[term] = documents.get(term, 0) + 1
    return {t: (frequency[t], documents[t]) for t in frequency} | ({None: (0, len(newest))} if newest else {})


def test_counts_do_not_depend_on_the_order(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"c{r.randrange(12)}", r.randrange(4), " ".join(r.choice("abcd") for _ in range(r.randrange(5))) + r.choice(["", "\nx y"])) for _ in range(60)]
    rows += [("c1", 9, None), ("c2", 9, "")]
    want = plain(rows)
    for order in (1, 2):
        random.Random(order).shuffle(rows)
        source, table, state = (str(tmp_path / f"{name}{order}") for name in ("in", "out", "state"))
        for k in range(0, len(rows), 15):
            spark.createDataFrame(rows[k : k + 15], C.SCHEMA).coalesce(1).write.mode("append").parquet(source)
            # Every batch in a query of its own: each begins where the one before it ended.
            C.stream_counts(spark, source, table, state).awaitTermination()
        got = {x.term: (x.frequency, x.documents) for x in C.counts(spark, table).collect()}
        assert got == want
        C.stream_counts(spark, source, table, state).awaitTermination()
        assert {x.term: (x.frequency, x.documents) for x in C.counts(spark, table).collect()} == want
    n = want[None][1]
    idf = {x.term: x.idf for x in C.weights(spark, table).collect()}
    assert idf == {t: round(math.log((n + 1) / (d + 1)) + 1, 6) for t, (_, d) in want.items() if t}
