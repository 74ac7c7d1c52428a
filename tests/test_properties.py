"""Property tests: Spark expressions against plain-Python statements of the semantics."""

from __future__ import annotations

import random
import re
import urllib.parse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlens.functions import text as tx
from postlens.operators import extract, ingest

ALPHABET = "ab #xé中\t\n   　*~+/-_."


def _random_strings(seed: int, n: int = 300) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 24))) for _ in range(n)]


def test_clean_text_equals_python(spark):
    data = _random_strings(1)
    df = spark.createDataFrame([(s,) for s in data], "t string")
    got = [r[0] for r in df.select(tx.clean_text("t")).collect()]
    want = [re.sub(r"#\S+", "", s).strip() for s in data]
    assert got == want


def test_percent_encode_equals_python(spark):
    data = _random_strings(2)
    df = spark.createDataFrame([(s,) for s in data], "t string")
    got = [r[0] for r in df.select(extract.percent_encode(F.col("t"))).collect()]
    assert got == [urllib.parse.quote(s, safe="") for s in data]


def test_stop_word_text_equals_python(spark):
    data = _random_strings(3)
    stop = ["a", "ab", "#x"]
    df = spark.createDataFrame([(s,) for s in data], "t string")
    got = [r[0] for r in df.select(tx.drop_stop_words_text("t", tx.literal_array(stop))).collect()]
    want = [" ".join(w for w in s.split() if w not in stop) for s in data]
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["a", "b", None])), min_size=0, max_size=40),
       st.integers(1, 6), st.randoms())
def test_fingerprint_independent_of_order_and_partitioning(spark, rows, parts, rnd):
    import datetime as dt

    data = [(dt.datetime(2024, 1, 1, i), u, f"t{i}") for i, u in rows]
    shuffled = data[:]
    rnd.shuffle(shuffled)
    schema = "postTimeRaw timestamp_ntz, username string, tweetText string"
    a = ingest.fingerprint(spark.createDataFrame(data, schema)).first()
    b = ingest.fingerprint(spark.createDataFrame(shuffled, schema).repartition(parts)).first()
    assert a == b
    assert a["n"] == len(data)


def test_global_row_number_equals_python_sort(spark):
    """Two-pass numbering = position in (time nulls last, post_id) order, for any partition count."""
    import datetime as dt

    from postlens.operators.numbering import global_row_number
    from postlens.operators.topics import batch_order

    rnd = random.Random(7)
    rows = []
    for pid in rnd.sample(range(10_000), 500):
        t = None if rnd.random() < 0.1 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 30))
        rows.append((pid, t))
    want = [pid for pid, t in sorted(rows, key=lambda r: (r[1] is None, r[1] or dt.datetime.min, r[0]))]
    df = spark.createDataFrame(rows, "post_id long, postTimeRaw timestamp_ntz").repartition(3)
    for parts in (1, 4, 9):
        got = global_row_number(df, batch_order(), partitions=parts).orderBy("rn").collect()
        assert [r.post_id for r in got] == want
        assert [r.rn for r in got] == list(range(1, len(rows) + 1))
