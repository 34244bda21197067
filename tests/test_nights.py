"""The night store and nightly rules over streams against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from evenloom.sources import snapshot, store
from evenloom.streaming import nights as N

DAY0 = dt.datetime(2024, 1, 1)


def plain(rows, rule, least, last):
    """Verdicts of rows (source, day, n) up to the day ``last``, night by night."""
    out = {}
    for source in {r[0] for r in rows}:
        counts = {}
        for s, d, n in rows:
            if s == source:
                counts[d] = max(n, counts.get(d, 0))
        state = None
        for d in range(min(counts), last + 1):
            if d not in counts and (state is None or state[1] < least):
                state = None
                continue
            if state is not None and state[1] < least and d - 1 not in counts:
                state = None
            verdict, state = rule(state, d * N.DAY, counts.get(d, 0))
            out[source, d] = (counts.get(d, 0), verdict)
    return out


def streamed(spark, tmp_path, rows, rule, files, delay):
    """Run the rows in so many files, one a batch; (verdicts, total state rows after each batch)."""
    root = tmp_path / f"{len(rows)}-{files}"
    chunks = [rows[k::files] for k in range(files)] if files == 1 else [rows[k * len(rows) // files : (k + 1) * len(rows) // files] for k in range(files)]
    for k, chunk in enumerate(chunks):
        spark.createDataFrame([(s, DAY0 + dt.timedelta(days=d), n) for s, d, n in chunk], "source string, night timestamp, n long").coalesce(1).write.mode("append").parquet(str(root / "in"))
    stream = spark.readStream.schema("source string, night timestamp, n long").option("maxFilesPerTrigger", 1).parquet(str(root / "in"))
    q = N.verdicts(stream, rule, delay=delay).writeStream.format("parquet").option("path", str(root / "out")).option("checkpointLocation", str(root / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    got = spark.read.parquet(str(root / "out")).collect()
    assert len({(r.source, r.night) for r in got}) == len(got)
    return {(r.source, (r.night - DAY0).days): (r.n, r.verdict) for r in got}, kept


def test_streams_equal_the_plain_fold(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for s in range(12):
        for d in range(25):
            if not (s % 3 == 0 and d > 8) and rng.random() > 0.25:
                rows.append((f"s{s}", d, rng.choice([0, 1, 5, 7, 30, 40])))
                if rng.random() < 0.2:
                    rows.append((f"s{s}", d, rng.choice([0, 3, 50])))
    rows.sort(key=lambda r: r[1] + rng.random() * 3)  # nights come up to three days late, some twice
    clock = ("clock", 80, 1)
    for rule, files in ((N.safety_rule(), 1), (N.safety_rule(), 5), (N.handover_rule(), 3)):
        got, kept = streamed(spark, tmp_path / rule.__qualname__, [*rows, clock], rule, files, "6 days")
        want = plain(rows, rule, 6, 73)
        assert {k: v for k, v in got.items() if k[0] != "clock"} == want
        assert kept[-1] <= 2 < max(kept)  # all sources have been let go; the clock waits
    assert any(v == "vervallen" and n == 0 for n, v in want.values())


def test_a_night_is_written_once_however_often(spark, tmp_path):
    path = str(tmp_path / "nights")
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id long, date string")
    store.write_night(rows(1, 2, 3), "2024-01-01", path, "date")
    store.write_night(rows(9), "2024-01-02", path)
    store.write_night(rows(2, 4), "2024-01-01", path)
    store.write_night(rows().limit(0), "2024-01-02", path)
    got = lambda df: sorted((str(r.night), r.id) for r in df.collect())
    assert got(store.read_nights(spark, path)) == [("2024-01-01", 2), ("2024-01-01", 4), ("2024-01-02", 9)]
    assert got(store.latest_night(spark, path)) == [("2024-01-02", 9)]
    assert got(store.latest_night(spark, path, "2024-01-01")) == [("2024-01-01", 2), ("2024-01-01", 4)]
    assert got(store.read_nights(spark, path, first="2025-01-01")) == []


def test_documents_say_what_is_stale(spark, tmp_path):
    events = spark.createDataFrame([(0, "e1", "a", "t", "2024-01-02", "20:00"), (1, "e2", "b", "t", "2024-01-01", None)], "ord int, id string, v string, title string, date string, time string")
    venues = spark.createDataFrame([("a", "A", "X"), ("b", "B", "Y")], "v string, name string, city string")
    verdicts = spark.createDataFrame([("a", "houd", "2023-12-30"), ("b", "ok", "2024-01-01"), ("gone", "houd", "2023-12-01")], "v string, verdict string, ok string")
    path = str(tmp_path / "doc")
    snapshot.write_snapshot(events, venues, "2024-01-01 08:00", path, store.stale_map(verdicts))
    assert [(r.v, str(r.since)) for r in snapshot.read_stale(spark, path).collect()] == [("a", "2023-12-30")]
    assert [r.id for r in snapshot.read_snapshot(spark, path)[0].orderBy("ord").collect()] == ["e2", "e1"]
    snapshot.write_snapshot(events, venues, "2024-01-01 08:00", path)
    assert snapshot.read_stale(spark, path).collect() == []
    rows = store.published(events.withColumn("v", F.lit("a")), venues, store.stale_map(verdicts)).collect()
    assert {str(r.stale_since) for r in rows} == {"2023-12-30"}


def test_caches_merge_and_prune(spark):
    cache = spark.createDataFrame([("k", "1", "2024-01-01", "w1"), ("k", "2", "2024-01-02", "w1"), ("k", "3", "2024-01-02", "w0"), ("old", None, "2020-01-01", "w1"), ("used", "u", None, "w1"), ("used", "v", None, None)], "key string, value string, t string, writer string")
    merged = store.merged_caches(cache.limit(2), cache)
    assert {(r.key, r.value) for r in merged.collect()} == {("k", "2"), ("old", None), ("used", "u")}
    kept = store.pruned_cache(merged, spark.createDataFrame([("used",), ("used",), (None,)], "key string"), "2024-01-10")
    assert {r.key for r in kept.collect()} == {"k", "used"}
