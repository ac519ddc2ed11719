import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from driftmark.operators.versions import marks_around, nearest_version
from driftmark.streaming import change_feed
from driftmark.streaming.keyed_state import KeyedState

VALUE = "struct<n:bigint,text:string>"


def put(state, spark, batch_id, rows):
    fresh = spark.createDataFrame(rows, "key string, n long, text string").select("key", F.struct("n", "text").alias("value"))
    buckets = state.touched(fresh, batch_id)
    state.write(batch_id, fresh, buckets)
    return buckets


def held(state):
    return {r.key: (r.value.n, r.value.text) for r in state.all().collect()}


def test_state_splits_buckets_and_reads_those_it_needs(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "s"), "string", VALUE, bucket_rows=40)
    rnd, want, reads = random.Random(3), {}, []
    for batch_id in range(5):
        rows = {f"k{rnd.randrange(10**6)}" if rnd.random() < 0.9 else rnd.choice(sorted(want, key=repr) or ["first"]): batch_id for _ in range(400 if batch_id < 4 else 3)}
        if batch_id == 2:
            rows[None] = 7
        buckets = put(state, spark, batch_id, [(k, n, f"of {batch_id}") for k, n in rows.items()])
        reads.append(sum(b.rows for b in buckets))
        want |= {k: (n, f"of {batch_id}") for k, n in rows.items()}
        assert held(state) == want
        manifest = state.manifest().collect()
        assert sum(b.rows for b in manifest) == len(want)
        # The buckets cut the hashes into parts that don't overlap.
        bits = sorted(b.bits for b in manifest)
        assert all(not y.startswith(x) for x, y in zip(bits, bits[1:])) and max(b.rows for b in manifest) < 160
    assert len(manifest) > 10 and reads[0] == 0 and reads[4] < 0.4 * len(want)


def test_what_a_batch_reads_does_not_grow_with_the_state(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "s"), "string", VALUE, bucket_rows=50)
    reads = []
    for batch_id in range(4):
        put(state, spark, 2 * batch_id, [(f"{batch_id}-{i}", i, "bulk") for i in range(1500)])
        buckets = put(state, spark, 2 * batch_id + 1, [(f"{batch_id}-{i}", i, "again") for i in range(2)])
        reads.append(sum(b.rows for b in buckets))
    assert state.all().count() == 6000 and max(reads) <= 2 * 2 * 50


def test_a_batch_that_runs_again_or_failed_midway(spark, tmp_path):
    root = str(tmp_path / "s")
    state = KeyedState(spark, root, "string", VALUE, bucket_rows=4)
    put(state, spark, 0, [(f"k{i}", 0, "zero") for i in range(20)])
    before = held(state)
    put(state, spark, 1, [("k1", 1, "one"), ("new", 1, "one")])
    after = held(state)
    # The same batch once more, from a new session of the feed.
    put(KeyedState(spark, root, "string", VALUE, bucket_rows=4), spark, 1, [("k1", 1, "one"), ("new", 1, "one")])
    assert held(state) == after == before | {"k1": (1, "one"), "new": (1, "one")}

    class Broken(KeyedState):
        def manifest(self, before=None):
            if self.armed:
                raise RuntimeError("lost")
            return super().manifest(before)

    broken = Broken(spark, root, "string", VALUE, bucket_rows=4)
    broken.armed = False
    fresh = spark.createDataFrame([("k2", 2, "two")], "key string, n long, text string").select("key", F.struct("n", "text").alias("value"))
    buckets = broken.touched(fresh, 2)
    broken.armed = True
    with pytest.raises(RuntimeError):
        broken.write(2, fresh, buckets)  # its buckets are written, its manifest is not
    assert held(state) == after
    put(state, spark, 2, [("k2", 2, "two")])
    assert held(state) == after | {"k2": (2, "two")}


def test_feed_over_many_batches_keeps_state_by_bucket(spark, tmp_path):
    rnd = random.Random(9)
    schema = "id long, entity string, at long, value string"
    rows, landing = [], str(tmp_path / "landing")
    for part in range(4):
        new = [(part * 1000 + i, rnd.choice([f"e{part}-{rnd.randrange(300)}", f"e0-{rnd.randrange(300)}", "hot", None]), part, f"v{i}") for i in range(300)]
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{landing}/part={part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{landing}/part=*")
    root = str(tmp_path / "feed")
    change_feed.start_change_feed(stream, root, f"{root}/cp", "entity", ["at", "id"], ["id", "value"], bucket_rows=20).awaitTermination()
    last, want = {}, set()
    for id_, entity, _, value in sorted(rows, key=lambda r: (r[2], r[0])):
        want.add((id_, last.get(entity)))
        last[entity] = id_
    assert {(r.id, r.previous.id if r.previous else None) for r in change_feed.read_transitions(spark, root).collect()} == want
    known = change_feed.last_known(spark, root, "entity", "string", "id:bigint,value:string")
    assert {r.entity: r.version.id for r in known.collect()} == last
    costs = {r.batch_id: (r.buckets_read, r.rows_read) for r in change_feed.read_costs(spark, root).collect()}
    assert sorted(costs) == [0, 1, 2, 3] and costs[0] == (0, 0) and costs[3][0] > 1


def nearest(marks, t):
    return None if t is None or not marks else min((abs(t - m), m, s) for m, s in marks)[2]


@pytest.mark.parametrize("n_marks", [0, 1, 7])
def test_nearest_of_few_marks_over_many_partitions(spark, n_marks):
    rnd = random.Random(n_marks)
    marks = [(rnd.randint(0, 1000), f"s{i}") for i in range(n_marks)]
    events = [(i, rnd.randint(-500, 1500)) for i in range(300)] + [(900 + i, 77) for i in range(500)] + [(5000, None)]
    ms = spark.createDataFrame(marks, "s long, sid string").select(F.timestamp_seconds("s").alias("m"), "sid")
    es = spark.createDataFrame(events, "e int, s long").select("e", F.timestamp_seconds("s").alias("t")).repartition(6)
    got = {r.e: r.sid for r in nearest_version(es, "t", ms, "m", "sid").collect()}
    assert got == {e: nearest(marks, t) for e, t in events}


def test_nearest_of_ten_thousand_marks_in_a_day_meets_two_each(spark):
    rnd = random.Random(1)
    times = sorted({rnd.randrange(86_400_000_000) for _ in range(10_000)})
    asked = sorted({rnd.randrange(86_400_000_000) for _ in range(20_000)} | set(times[:50]))
    marks = spark.createDataFrame([(t, str(t)) for t in times], "t long, id string")
    found = marks_around(spark.createDataFrame([(t,) for t in asked], "t long"), marks)
    rows = found.collect()
    assert len(rows) == len(asked)
    for r in rows:
        at = bisect_left(times, r.t)
        later = times[at] if at < len(times) else None
        earlier = later if later == r.t else times[at - 1] if at else None
        assert (r.earlier and r.earlier.t, r.later and r.later.t) == (earlier, later)
    # The only join of the scan is with one row per partition.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_nearest_of_nothing(spark):
    es = spark.createDataFrame([], "e int, t timestamp")
    ms = spark.createDataFrame([], "m timestamp, sid string")
    assert nearest_version(es, "t", ms, "m", "sid").columns == ["e", "t", "sid"] and nearest_version(es, "t", ms, "m", "sid").count() == 0
