"""Alerts are walked through in order, with no user's events in one piece, and carry their state over batches."""

from loamline.sources.tables import events
from loamline.streaming import event_streams
from pyspark.sql.streaming import DataStreamReader

SF = "/root/testdata/sf0.001"


def _plain(rows, wait):
    last, out = {}, set()
    for r in rows:
        if r.user_id not in last or r.t - last[r.user_id] >= wait:
            last[r.user_id] = r.t
            out.add((r.event_id, r.user_id, r.t))
    return out


def test_alerts_over_batches(spark, tmp_path, monkeypatch):
    def refuse(*a, **b):
        raise AssertionError("all of a user's events in one piece")

    monkeypatch.setattr("pyspark.sql.pandas.group_ops.PandasGroupedOpsMixin.applyInPandasWithState", refuse)
    rows = events(spark, SF).select("event_id", "user_id", "t").orderBy("t", "event_id").collect()
    source = spark.read.parquet(f"{SF}/events.parquet")
    cut = sorted(r[0] for r in source.select("ts").collect())[len(rows) // 2]
    for part in (source.filter(source.ts < cut), source.filter(source.ts >= cut)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    whole = DataStreamReader.parquet
    monkeypatch.setattr(DataStreamReader, "parquet", lambda self, *a, **b: whole(self.option("maxFilesPerTrigger", 1), *a, **b))
    for wait in (6 * 3_600_000_000, 10**12):
        got = [tuple(r) for r in event_streams.stream_alerts(spark, str(tmp_path), wait).collect()]
        assert len(got) == len(set(got)) and set(got) == _plain(rows, wait)


def test_rates_over_batches(spark, tmp_path, monkeypatch):
    source = spark.read.parquet(f"{SF}/events.parquet")
    for part in (source.filter("event_id % 2 = 0"), source.filter("event_id % 2 = 1")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    whole = DataStreamReader.parquet
    monkeypatch.setattr(DataStreamReader, "parquet", lambda self, *a, **b: whole(self.option("maxFilesPerTrigger", 1), *a, **b))
    want = {}
    for r in events(spark, SF).select("event_id", "t").collect():
        n, latest = want.get(r.t // 3_600_000_000, (0, (0, 0)))
        want[r.t // 3_600_000_000] = (n + 1, max(latest, (r.t, r.event_id)))
    got = event_streams.stream_rates(spark, str(tmp_path)).collect()
    assert {r.slot: (r.n, r.latest_id) for r in got} == {k: (n, e) for k, (n, (_, e)) in want.items()}
