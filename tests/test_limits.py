import random
from datetime import datetime, timedelta

from engram.operators.windows import rate_limit
from engram.streaming.jobs import limited, read_stream, run_once

EVENTS = "user string, ts timestamp, event_id long"
START = datetime(2024, 1, 1)


def streamed(spark, tmp_path, files, **kw):
    """The rows of a stream over files, one a batch."""
    schema = spark.createDataFrame([], EVENTS).schema
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in{k:03d}"))
    stream = read_stream(spark, str(tmp_path / "in*"), schema, files_per_batch=1)
    name = f"limits{random.randrange(10**9)}"
    run_once(limited(stream, "user", **kw), name=name, checkpoint=str(tmp_path / "state"))
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_stream_equals_batch_over_shuffled_files(spark, tmp_path):
    """Rows come up to a minute out of order, with ties, a key without a name, and rows without a time."""
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), at(r.randrange(400) + r.random()), k) for k in range(150)] + [("a", at(50), 900), ("a", at(50), 901), ("b", None, 902)]
    came = sorted(rows, key=lambda x: (x[1] or START) + timedelta(seconds=r.random() * 55))
    files = [came[k : k + 40] for k in range(0, len(came), 40)] + [[("end", at(5000), 999)]]
    got = [x for x in streamed(spark, tmp_path, files, most=3, seconds=20) if x[0] != "end"]
    batch = rate_limit(spark.createDataFrame(rows, EVENTS), "user", "ts", "event_id", most=3, seconds=20)
    expected = sorted(map(tuple, batch.collect()), key=str)
    assert got == expected and len(got) == 152 and {x[3] for x in got} == {True, False}


def test_the_31st_of_a_minute_is_turned_away_and_late_rows_go(spark, tmp_path):
    """A late row that comes in the batch in which those around it are judged still counts; one that comes after it goes."""
    files = [[("a", at(k), k) for k in range(31)], [("a", at(61), 61), ("x", at(300), 300)], [("x", at(600), 301)], [("a", at(5), 1000), ("x", at(900), 302)]]
    got = {x[2]: x[3] for x in streamed(spark, tmp_path, files)}
    assert [got[k] for k in range(31)] == [True] * 30 + [False] and got[61] and 1000 not in got
