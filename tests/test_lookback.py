"""Look-backs from parts that a stream keeps, against the same from the whole log."""

import datetime as dt
import math
import random

from quarry.streaming import lookback

START = dt.datetime(2026, 3, 1)
LOG = "created_at timestamp, status_code int, cache_hit boolean, latency_ms double, tokens_input long, tokens_output long"


def made(n):
    rng = random.Random(1)
    return [
        (START + dt.timedelta(minutes=i * 2 + rng.randrange(30)), rng.choice([200, 200, 500]), rng.random() < 0.3, rng.choice([None, 0.0, round(rng.uniform(0.01, 900), 3)]), rng.randrange(99), rng.randrange(99))
        for i in range(n)
    ]


def plain(rows, hours):
    newest = max(r[0] for r in rows).replace(minute=0, second=0)
    own = [r for r in rows if r[0].replace(minute=0, second=0) > newest - dt.timedelta(hours=hours)]
    times = sorted(r[3] for r in own if r[3] is not None)
    edge = lambda v: 0.0 if v == 0 else round(2 ** ((math.floor(math.log2(v) * 64) + 1) / 64), 2)
    at = lambda s: edge(times[math.ceil(len(times) * s) - 1])
    return (hours, len(own), sum(r[1] >= 400 for r in own), sum(r[2] for r in own), round(sum(times) / len(times), 1), round(min(times), 1), round(max(times), 1), at(0.5), at(0.95), sum(r[4] for r in own), sum(r[5] for r in own))


def test_look_backs_of_a_table_and_of_a_stream_that_grows(spark, tmp_path):
    rows = made(900)
    whole = spark.createDataFrame(rows, LOG)
    want = [plain(rows, h) for h in (1, 24, 168)]
    take = lambda parts: [tuple(r)[:-1] for r in lookback.look_backs(parts).orderBy("hours").collect()]
    assert take(lookback.hourly_parts(whole)) == want
    at, state = str(tmp_path / "parts"), str(tmp_path / "state")
    for k in range(0, 900, 300):
        spark.createDataFrame(rows[k : k + 300], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        lookback.keep_hourly(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), at, state)
        assert take(lookback.read_hourly(spark, at)) == [plain(rows[: k + 300], h) for h in (1, 24, 168)]
    assert lookback.look_backs(lookback.hourly_parts(whole.limit(0))).collect() == []
