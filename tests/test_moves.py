"""What moves between tasks: plans whose shuffles must not grow with an expansion."""

from datetime import datetime

import pytest
from pyspark.sql import DataFrame

from newsloom.operators import popularity_log, ranking
from newsloom.queries import streams
from newsloom.queries.bindings import Newsroom


def plan(frame: DataFrame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_windows_are_summed_where_the_entity_lies(spark):
    day = datetime(2024, 1, 1)
    rows = [(day, "a", "A", "PLAYER", 2), (day.replace(hour=3), "a", "A", "PLAYER", 1), (None, "b", "B", "CLUB", 9)]
    buckets = spark.createDataFrame(rows, "bucket timestamp, entity_id string, canonical_name string, entity_type string, articles long")
    counts = ranking.sliding_counts(buckets)
    assert "hashpartitioning(window_end" not in plan(counts)
    found = {(r.window_end, r.mention_count, r.window_articles) for r in counts.collect()}
    assert found == {
        (datetime(2024, 1, 1, 3), 2, 2), *((datetime(2024, 1, 1, h), 3, 1 if h == 6 else 0) for h in range(6, 24, 3)),
        (datetime(2024, 1, 2), 3, 0), (datetime(2024, 1, 2, 3), 1, 0),
    }


def test_pairs_move_once_to_be_counted(spark):
    day = datetime(2024, 1, 1)
    rows = [("1", day, day, "e", "A", "CLUB"), ("1", day, day, "e", "B", "CLUB"), ("2", day, day, "e", "A", "COACH")]
    pairs = spark.createDataFrame(rows, "article_id string, crawl_date timestamp, bucket timestamp, entity_id string, name string, type string")
    counted = popularity_log._counted(pairs, ["bucket"])
    assert plan(counted).count("Exchange") == 1
    found = {(r.name, r.type, r.articles) for r in counted.collect()}
    assert found == {(None, None, 2), ("A", None, 2), ("B", None, 1), (None, "CLUB", 1), (None, "COACH", 1), ("A", "CLUB", 1), ("B", "CLUB", 1), ("A", "COACH", 1)}


@pytest.mark.parametrize("parts", [1, 8])
def test_slices_of_the_stream_are_written_without_a_shuffle(spark, monkeypatch, tmp_path, parts):
    """Rows of many partitions are not dealt out anew; those of few are, as a micro-batch takes a number of files."""
    room = Newsroom(spark, "/root/testdata/sf0.01")
    rows = streams._mention_rows(room).repartition(parts).localCheckpoint()
    monkeypatch.setattr(streams, "_mention_rows", lambda room: rows)
    monkeypatch.setattr(streams, "_place", lambda room, name: str(tmp_path))
    dealt = []
    kind = type(rows)
    deal = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *by: dealt.append(by) or deal(self, *by))
    streams._mention_stream(room)
    assert len(dealt) == (streams.SLICES if parts == 1 else 0)
    for number in range(streams.SLICES):
        assert len(list((tmp_path / f"slice-{number}").glob("*.parquet"))) == streams.SLICE_FILES
