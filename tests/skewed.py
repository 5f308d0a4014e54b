"""A fixture in which one group holds over a third of the rows and one value is widely shared."""

import datetime
import random

SCHEMA = "id bigint, k bigint, x double, ts timestamp_ntz, v bigint, name string"


def skewed(spark, rows=3000, seed=7):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    data = []
    for i in range(rows):
        shape = rng.random()
        k = 7 if shape < 0.4 else None if shape < 0.6 else rng.randrange(40)
        x = rng.choice([None, float("nan"), 5.0, 5.0, 5.0, 5.0, rng.gauss(0, 50), 1e9 * rng.random()])
        ts = start + datetime.timedelta(microseconds=rng.randrange(20 * 86_400) * 1_000_003)
        v = None if rng.random() < 0.3 else rng.randrange(1000)
        data.append((i, k, x, ts, v, f"n{i % 11}"))
    return spark.createDataFrame(data, SCHEMA).repartition(8)


def rows_of(df, *columns):
    """Rows as sorted text, so that NaN and null compare."""
    return sorted(map(repr, df.select(*columns).collect()))
