"""The bucket log over several micro-batches, against a plain retelling."""

import random
import tempfile
from collections import Counter
from datetime import datetime, timedelta

from newsloom.streaming import bucket_log

HOURS = timedelta(hours=3)
START = datetime(2024, 1, 1)
ROW = "article_id string, entity_id string, canonical_name string, entity_type string, crawl_date timestamp"


def floor(moment):
    return datetime(1970, 1, 1) + (moment - datetime(1970, 1, 1)) // HOURS * HOURS


def told_plainly(batches, lateness):
    """Late rows, closed 3-hour counts and closed 24-hour counts."""
    late, pairs, latest = [], set(), None
    for number, rows in enumerate(batches):
        closed = floor(latest - lateness) if latest else None
        for row in rows:
            if row[4] is not None and closed and floor(row[4]) < closed:
                late.append((*row, number))
            elif row[4] is not None:
                pairs.add((*row[:4], floor(row[4])))
        latest = max([m for m in [latest, *(r[4] for r in rows)] if m], default=None)
    border = floor(latest - lateness)
    buckets, windows = Counter(), Counter()
    for _, *key, start in pairs:
        if start < border:
            buckets[(start, *key)] += 1
        for k in range(1, 9):
            if start + k * HOURS <= border:
                windows[(start + k * HOURS, *key)] += 1
    return late, buckets, windows


def test_bucket_log_in_batches_with_a_retry(spark):
    rng = random.Random(9)
    batches = []
    for day in range(6):
        at = START + timedelta(hours=10 * day)
        rows = [
            (f"a{rng.randrange(40)}", f"e{rng.randrange(3)}", rng.choice(["n", None]), "CLUB", at + timedelta(minutes=rng.randrange(-900, 500)))
            for _ in range(rng.choice([0, 30, 60]) if day else 40)
        ]
        batches.append(rows + rows[:5] + ([("x", "e0", "n", "CLUB", None)] if day == 2 else []))
    batches.append([("gap", "e1", "n", "CLUB", START + timedelta(days=6))])
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    log = bucket_log.BucketLog(root, timedelta(hours=1))
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, ROW)
        log.process(frame, number)
        if number in (0, 3):
            log.process(frame, number)  # a batch that runs again
    late, buckets, windows = told_plainly(batches, timedelta(hours=1))
    assert late and buckets and windows
    assert sorted(map(repr, (tuple(r) for r in bucket_log.late_rows(spark, root).collect()))) == sorted(map(repr, late))
    assert Counter({tuple(r)[:4]: r[4] for r in bucket_log.closed_buckets(spark, root).collect()}) == buckets
    found = bucket_log.closed_windows(spark, root).collect()
    assert len(found) == len(windows) and Counter({tuple(r)[:4]: r[4] for r in found}) == windows
    empty = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    bucket_log.BucketLog(empty).process(spark.createDataFrame([], ROW), 0)
    assert bucket_log.closed_windows(spark, empty).count() == 0
    assert bucket_log.late_rows(spark, f"{empty}/none").count() == 0
