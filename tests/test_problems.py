"""The general data problems against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.change_capture import ChangeCapture, committed_offsets
from millrace.operators.entity_history import EntityHistory
from millrace.operators.lambda_periods import LambdaPeriods
from millrace.operators.ranks import positions
from millrace.operators.regular_grid import RegularGrid, epoch_seconds, ssa_fill
from millrace.operators.spikes import Spikes, active_hampel, hampel, rolling_median, run_lengths, usual_band
from millrace.session import shared_dir

T0 = datetime(2024, 1, 1)
MODELS = "execution_id long, model_name string, tenant string, started_at timestamp_ntz, recorded_at timestamp_ntz, status string, duration_ms long, rows_copied long, partition_key string, partition_start timestamp_ntz, partition_end timestamp_ntz, metadata_watermark timestamp_ntz, id string, p string, value string, layer string"


def model(i, start=T0, name="m", key=None, ps=None, pe=None, arrived=None, status="success", d=1, r=1, tenant="t", mark=None):
    return (i, name, tenant, start, arrived or (start and start + timedelta(minutes=1)), status, d, r, key, ps, pe, mark, "x", "y", "z", "w")


def h(x):
    return timedelta(hours=x)


class TestLambdaPeriods:
    ROWS = [
        model(1, T0 + h(1), key="2024-01-01T00"),  # on time, at the end of the period
        model(2, T0 + h(3), key="2024/01/01 00"),  # exactly 2 h late: still on time
        model(3, T0 + h(3.01), key=" 2024010100 "),  # late
        model(3, T0 + h(3.01), key="2024010100"),  # delivered twice
        model(4, T0 + h(73), key="2024-01-01t00"),  # exactly 72 h: late
        model(5, T0 + h(73.01), key="2024-01-01T00"),  # closed
        model(6, T0 + h(30), key="20240101", status=" Success "),  # a day
        model(7, T0 + h(24 * 31 + 5), key="2024-01"),  # a month
        model(8, T0 + h(5), ps=T0, pe=T0 + h(1)),  # no key: its bounds
        model(9, T0 + h(5), pe=T0 + h(1)),  # only an end
        model(10, T0 + h(5), ps=T0),  # only a start: no period
        model(11, T0 + h(5), key="2024-01-01T00", status="failed"),
        model(12, None, key="2024-01-01T00", arrived=T0),
        model(13, T0 + h(5), key="nonsense", pe=T0 + h(1)),
        model(None, T0 + h(5), key="2024-01-01T00"),
        model(14, T0 + h(5), key="2024-13-40T77", pe=T0 + h(1)),
        model(15, T0 + h(5), key="2024-01-01T00", r=None),
    ]

    def test_layers(self, spark):
        got = {r["id"]: r["layer"] for r in LambdaPeriods().ledger(spark.createDataFrame(self.ROWS, MODELS)).collect()}
        assert got == {1: "fast", 2: "fast", 3: "batch", 4: "batch", 5: "closed", 6: "batch", 7: "batch", 8: "batch", 9: "batch", 10: "unresolved", 12: "unresolved", 13: "batch", 14: "batch", 15: "batch"}

    def test_views_fast_batch_freeze(self, spark):
        p = LambdaPeriods(delivery_h=0)
        log = [
            model(1, T0 + h(1.5), key="2024-01-01T00", r=10),
            model(1, T0 + h(1.5), key="2024-01-01T00", r=10, arrived=T0 + h(1.6)),
            model(2, T0 + h(40), key="2024-01-01T00", r=5),  # late, before the cut-off
            model(3, T0 + h(50), key="2024-01-01T00", r=7, arrived=T0 + h(100)),  # arrives after the freeze (at 96 h)
        ]
        df, e = spark.createDataFrame(log, MODELS), lambda x: int((T0 + h(x)).timestamp() - T0.timestamp()) + 1704067200
        fast = p.fast(df, e(0), e(24)).first()
        assert (fast["executions"], fast["rows_copied"]) == (2, 20)  # provisional: repeats aren't removed
        first = p.batch(df, None, e(24))
        assert (first.first()["executions"], first.first()["frozen"]) == (1, False)
        served = p.serve(first, p.fast(df, e(24), e(48))).collect()
        assert [r["executions"] for r in served] == [1]
        view, members = p.run(df, [e(24), e(48), e(96), e(120)])
        r = view.first()
        assert [x['id'] for x in p.corrections(members).collect()] == [2] and sorted(x['id'] for x in members.collect()) == [1, 2]
        assert (r["executions"], r["rows_copied"], r["late_executions"], r["frozen"]) == (2, 15, 1, True)
        assert [x["id"] for x in p.ledger(df).filter("frozen_out").collect()] == [3]

    def test_streamed_fast_layer(self, spark, tmp_path):
        from millrace.streaming.stream import period_increments

        src, p = str(tmp_path / "log"), LambdaPeriods()
        spark.createDataFrame(self.ROWS[:4], MODELS).coalesce(1).write.parquet(src)
        run = lambda: {r["period_end"]: r["executions"] for r in period_increments(spark, src, MODELS, p, str(tmp_path / "inc"), str(tmp_path / "cp")).collect()}
        assert run() == {1704070800: 2} == run()
        spark.createDataFrame([model(50, T0 + h(1), key="2024-01-01T00")], MODELS).coalesce(1).write.mode("append").parquet(src)
        assert run() == {1704070800: 3}

    def test_empty(self, spark):
        df = spark.createDataFrame([], MODELS)
        p = LambdaPeriods()
        assert p.schedule(df) == [] and [x.count() for x in p.run(df, [])] == [0, 0]
        assert [x.count() for x in p.run(df, [0, 86400])] == [0, 0]

    def test_schedule_does_not_change_what_is_found(self, spark):
        rng, p = random.Random(9), LambdaPeriods()
        rows = []
        for i in range(400):
            start, key = T0 + h(rng.randrange(900)), T0 + h(rng.randrange(900))
            rows.append(model(i, start, rng.choice(["a", "a", "b"]), key=key.strftime("%Y-%m-%dT%H"), arrived=start + h(rng.randrange(120))))
        df = spark.createDataFrame(rows + rows[:40], MODELS)
        want = {r["id"] for r in p.ledger(df).filter("layer = 'batch'").collect()}
        for days in (3, 14, 100):
            view, members = p.run(df, p.schedule(df, days))
            assert {r["id"] for r in p.corrections(members).collect()} == want and members.count() == members.select("id").distinct().count()
            assert sum(r["late_executions"] for r in view.collect()) == len(want)


class TestGrid:
    def test_units(self, spark):
        df = spark.createDataFrame([(1_700_000_001,), (1_700_000_001_999,), (1_700_000_001_999_999,), (1_700_000_001_999_999_999,), (None,)], "t long")
        assert [r[0] for r in df.select(epoch_seconds(F.col("t"))).collect()] == [1_700_000_001] * 4 + [None]

    def test_missing_slots_brute_force(self, spark):
        rng = random.Random(1)
        rows = []
        for s in range(4):
            for k in range(900):
                if rng.random() < 0.4 or 300 < k < 560:
                    continue
                t = 1_700_000_000 + 300 * k + rng.randrange(300)
                rows.append((f"s{s}", t, rng.choice([None, -1, 0, 5, 9])))
        rows += [(None, 1_700_000_000, 5), ("s9", None, 5), ("s8", 1_700_000_000, 7)]
        again = rows[:50] * 3  # delivered again: counts once
        df = spark.createDataFrame(rows + again, "soak_id string, t long, fd_total long").withColumns({"slot": F.lit("x"), "value": F.lit("y"), "source": F.lit("z")})
        g = RegularGrid(block_slots=64, margin=12)
        got = g.fill(g.slots(df, "soak_id", "fd", F.col("t"), F.col("fd_total") > 0, F.col("fd_total"))).collect()
        have = defaultdict(lambda: defaultdict(list))
        for s, t, v in rows:
            if s and t and v and v > 0:
                have[s][t // 300 * 300].append(v)
        want = {(s, x) for s, m in have.items() for x in range(min(m), max(m) + 1, 300) if x not in m}
        assert {(r["source"], r["slot"]) for r in got if r["missing"]} == want
        assert len(got) == sum((max(m) - min(m)) // 300 + 1 for m in have.values())
        for r in got:
            assert r["value"] is not None
            if not r["missing"]:
                assert r["value"] == pytest.approx(np.mean(have[r["source"]][r["slot"]]))

    def test_ssa_recovers_a_wave(self):
        t = np.arange(400)
        x = 50 + 10 * np.sin(t / 9) + 4 * np.cos(t / 23)
        y = x.copy()
        y[[50, 51, 52, 53, 54, 120, 200, 201, 202, 300]] = np.nan
        z, n, done = ssa_fill(y, window=60, rank=6, rounds=2000, tol=1e-6)
        assert n > 1 and done and not ssa_fill(y, window=60, rank=6, rounds=1)[2] and np.abs(z - x).max() < 0.5 and np.abs(np.interp(t, t[~np.isnan(y)], y[~np.isnan(y)]) - x).max() > np.abs(z - x).max()

    def test_counts_and_empty(self, spark):
        g = RegularGrid()
        df = spark.createDataFrame([("a", 5, "r1"), ("a", 6, "r1"), ("a", 7, "r2"), ("a", 700, "r3")], "s string, t long, run string")
        got = sorted((r["slot"], r["value"], r["missing"]) for r in g.fill(g.slots(df, "s", "runs", F.col("t"), count_of="run")).collect())
        assert [(a, c) for a, _, c in got] == [(0, False), (300, True), (600, False)] and got[0][1] == 2
        assert g.fill(g.slots(df.limit(0), "s", "x", F.col("t"), value=F.col("t"))).count() == 0


ORDERS = "row_id long, order_id long, tenant string, customer_id long, order_date date, status string, total_amount decimal(10,2), _fivetran_synced timestamp_ntz, key string, v string, off string"


class TestCapture:
    def rows(self, n=400, seed=3):
        rng = random.Random(seed)
        out = []
        for i in range(n):
            o = rng.randrange(60)
            out.append((i, o if rng.random() > 0.02 else None, f"t{o % 4}", rng.choice([None, 1, 2]), None, rng.choice([None, "a", "b"]), None, T0 + timedelta(minutes=rng.randrange(50)) if rng.random() > 0.05 else None, "k", "v", "o"))
        return out

    def brute(self, rows, marks):
        new, old = {}, {}
        for r in rows:
            if r[1] is None or r[2] is None or r[7] is None:
                continue
            m = marks.get(r[2])
            side = new if m is None or r[7] > m else old
            side[r[1]] = max(side.get(r[1], r), r, key=lambda x: (x[7], x[0]))
        return {k for k, r in new.items() if k not in old or r[3:7] != old[k][3:7]}

    def test_brute_force(self, spark):
        rows, marks = self.rows(), {"t0": T0 + timedelta(minutes=20), "t1": T0 + timedelta(minutes=49), "t2": None}
        att = [model(1, T0, "stg", mark=T0 + timedelta(minutes=5), tenant="t0"), model(2, T0 + h(1), "stg", mark=marks["t0"], tenant="t0", status=" SUCCESS"), model(3, T0 + h(2), "stg", mark=T0 + h(9), tenant="t0", status="failed"), model(4, T0, "stg", mark=marks["t1"], tenant="t1"), model(5, T0, "stg", tenant="t2"), model(6, T0 + h(3), "other", mark=T0 + h(9), tenant="t0")]
        log = spark.createDataFrame(rows, ORDERS)
        c = ChangeCapture()
        batch, folder = c.run(log, floors=committed_offsets(spark.createDataFrame(att, MODELS), "stg"))
        assert {r["key"] for r in c.changes(batch).collect()} == self.brute(rows, marks)
        assert self.content(c.sink(spark, folder)) == self.newest(rows)

    def newest(self, rows):
        out = {}
        for r in rows:
            if r[1] is not None and r[2] is not None and r[7] is not None and (r[1] not in out or (out[r[1]][7], out[r[1]][0]) < (r[7], r[0])):
                out[r[1]] = r
        return {k: (r[0], r[5]) for k, r in out.items()}

    def content(self, sink):
        rows = sink.collect()
        assert len(rows) == len({r["key"] for r in rows})
        return {r["key"]: (r["ord"], r["v"]["status"]) for r in rows}

    def test_late_delivery_is_processed_once(self, spark):
        rows = self.rows()
        c = ChangeCapture()
        _, folder = c.run(spark.createDataFrame(rows, ORDERS))
        # both arrive later, with stamps before anything else: one is the first of its key, one older than what the sink has
        late = [(9000, 777, "t1", 5, None, "first", None, T0 - h(9), "k", "v", "o"), (9001, 7, "t3", 5, None, "old", None, T0 - h(9), "k", "v", "o")]
        log = spark.createDataFrame(rows + late, ORDERS)
        batch, _ = c.run(log, folder)
        assert {(r["key"], r["state"]) for r in batch.collect()} == {(777, "new"), (7, "stale")}
        assert self.content(c.sink(spark, folder)) == self.newest(rows + late)
        assert c.run(log, folder)[0].count() == 0
        c.compact(spark, folder)
        assert self.content(c.sink(spark, folder)) == self.newest(rows + late) and c.run(log, folder)[0].count() == 0

    @pytest.mark.parametrize("crash", ["plan", "process", "commit"])
    def test_replay_after_a_crash(self, spark, crash):
        rows, c, folder = self.rows(), ChangeCapture(), shared_dir(spark, "capture")
        log = spark.createDataFrame(rows[:300], ORDERS)
        c.run(log.filter("row_id < 200"), folder)
        n = c.plan(log, folder)
        if crash != "plan":
            c.process(log, folder, n)
        if crash == "commit":
            c.commit(spark, folder, n)
        # later deliveries arrive before the run is repeated
        full = spark.createDataFrame(rows, ORDERS)
        before = self.content(c.sink(spark, folder))
        assert before == self.newest(rows[:300] if crash == "commit" else rows[:200])
        batch, _ = c.run(full, folder)
        took = {r["ord"] for r in batch.collect()}
        assert all(200 <= o < 300 for o in took) if crash != "commit" else all(o >= 300 for o in took)
        c.run(full, folder)
        assert self.content(c.sink(spark, folder)) == self.newest(rows) and c.run(full, folder)[0].count() == 0

    def test_later_runs_read_beyond_the_offset_only(self, spark, tmp_path):
        path, c = str(tmp_path / "log"), ChangeCapture()
        spark.createDataFrame(self.rows(), ORDERS).write.parquet(path)
        log = spark.read.parquet(path)
        _, folder = c.run(log)
        plan = c.delta(log, folder, c.plan(log, folder))._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThan(row_id,399)" in plan

    def test_empty(self, spark):
        log, c = spark.createDataFrame([], ORDERS), ChangeCapture()
        batch, folder = c.run(log, floors=committed_offsets(spark.createDataFrame([], MODELS), "stg"))
        assert batch.count() == 0 and c.sink(spark, folder).count() == 0 and c.run(log, folder)[0].count() == 0


class TestSpikes:
    def series(self, rng, kind, n):
        if kind == "steady":
            return [int(rng.uniform(900, 1300)) for _ in range(n)]
        if kind == "peaks":
            return [int(rng.uniform(9000, 12000)) if i % 14 == 0 else int(rng.uniform(800, 1200)) for i in range(n)]
        if kind == "levels":
            return [int(rng.uniform(1000, 1500) * (1 if i < n // 2 else 12)) for i in range(n)]
        if kind == "quiet":
            return [0 if rng.random() < 0.6 else int(rng.uniform(5000, 8000)) for _ in range(n)]
        return [777] * n

    @pytest.mark.parametrize("kind", ["steady", "peaks", "levels", "quiet", "constant"])
    def test_planted(self, spark, kind):
        rng = random.Random(kind)
        x = self.series(rng, kind, 600)
        hi = max(x)
        x[100], x[333], x[450] = hi * 20, -5, None
        want = {(100, "spike"), (333, "impossible")}
        if kind in ("steady", "peaks", "levels"):
            x[200] = 1
            x[500:507] = [x[500]] * 7
            x[520:525] = [x[520]] * 5
            want |= {(200, "spike")} | {(i, "stuck") for i in range(500, 507)}
        rows = [model(i, T0 + timedelta(minutes=i), kind, d=v, r=None) for i, v in enumerate(x)]
        rows += [rows[7], rows[500], model(None, T0, kind, d=-9), model(10_000, T0, None, d=-9)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, MODELS)
        for s in (Spikes(), Spikes(block=64)):
            got = s.flags(df).collect()
            assert {(r["id"], r["reason"]) for r in got if r["reading"] == "duration_ms"} == want
            assert len(got) == len({(r["id"], r["reading"]) for r in got})

    def test_pieces(self):
        x = np.random.default_rng(0).normal(size=100)
        want = [np.median(x[max(0, i - 5) : i + 6]) for i in range(100)]
        assert np.allclose(rolling_median(x, 5), want) and np.allclose(rolling_median(x[:4], 5), [np.median(x[:4])] * 4) and len(rolling_median(x[:0], 5)) == 0
        assert run_lengths(np.array([1, 1, 2, 3, 3, 3])).tolist() == [2, 2, 1, 3, 3, 3]
        lo, hi = usual_band(np.array([0]), np.array([1]), np.array([1.0]), np.array([1.0]), 0.015, 0.003, 12)
        assert np.isnan(lo) and np.isnan(hi)

    def test_filter_decides(self, spark):
        rng = random.Random(3)
        x = [int(rng.uniform(900, 1300)) for _ in range(400)]
        x[200], x[300] = 60_000, 6_000
        df = spark.createDataFrame([model(i, T0 + timedelta(minutes=i), "m", d=v, r=None) for i, v in enumerate(x)], MODELS)
        got = lambda **kw: {r["id"] for r in Spikes(**kw).flags(df).collect() if r["reason"] == "spike"}
        assert got() == {200, 300} and got(k=20) == {200} and got(k=1000) == set()

    def test_quiet_half_of_the_time(self):
        rng = np.random.default_rng(1)
        y = np.log1p(np.where(np.arange(300) % 2, rng.uniform(9000, 11000, 300), 0))
        y[151] = np.log1p(300_000)
        assert len(hampel(y, 12, 3.0, 0.05)) == 300 and active_hampel(y, 12, 3.0, 0.05)[151]
        on = np.where(y > 0, y, np.nan)
        med = np.array([np.nanmedian(on[max(0, i - 12) : i + 13]) for i in range(300)])
        mad = np.array([np.nanmedian(np.abs(on - med)[max(0, i - 12) : i + 13]) for i in range(300)])
        assert (active_hampel(y, 12, 3.0, 0.05) == (np.abs(y - med) > np.maximum(3 * 1.4826 * mad, 0.05))).all()
        assert not active_hampel(np.zeros(9), 2, 3.0, 0.05).any() and not active_hampel(np.ones(9), 2, 3.0, 0.05).any()

    def test_empty_and_one(self, spark):
        assert Spikes().flags(spark.createDataFrame([], MODELS)).count() == 0
        assert [(r["id"], r["reason"]) for r in Spikes().flags(spark.createDataFrame([model(1, d=-1, r=None), model(2, None, d=3, r=None)], MODELS)).collect()] == [(1, "impossible")]


CUSTOMERS = "row_id long, customer_id long, tier string, email string, _fivetran_deleted boolean, _fivetran_synced timestamp_ntz, e string, at string, seg string, gone string"


class TestHistory:
    def rows(self, n=1500, seed=5):
        rng = random.Random(seed)
        out = []
        for i in range(n):
            c = 1 if rng.random() < 0.35 else rng.randrange(40)
            out.append((i, c if rng.random() > 0.02 else None, rng.choice([None, "Gold", " gold", "silver", "silver ", "bronze"]), rng.choice([None, "a", "b"]), rng.choice([None, False, False, False, True]), T0 + timedelta(hours=rng.randrange(400)) if rng.random() > 0.02 else None, "e", "a", "s", "g"))
        return out

    def states(self, rows):
        per = defaultdict(dict)
        for r in rows:
            if r[1] is not None and r[5] is not None and (r[5] not in per[r[1]] or per[r[1]][r[5]][0] < r[0]):
                per[r[1]][r[5]] = r
        return {c: [(t, (m[t][2] or "").strip().lower() if m[t][2] is not None else None, m[t][3], bool(m[t][4])) for t in sorted(m)] for c, m in per.items() if m}

    def test_brute_force(self, spark):
        rows = self.rows()
        want = set()
        for c, s in self.states(rows).items():
            cur = None
            for t, tier, _, gone in s:
                if cur and (gone or tier != cur[1]):
                    want.add((c, cur[1], cur[0], t))
                    cur = None
                if not gone and not cur:
                    cur = (t, tier)
            if cur:
                want.add((c, cur[1], cur[0], None))
        df = spark.createDataFrame(rows, CUSTOMERS)
        for kw in ({}, {"every": 3, "block": 7}, {"every": 1, "block": 64}):
            hist = EntityHistory(**kw)
            cp, patches = hist.build(df)
            sizes = [r["count"] for r in patches.groupBy("e", "seg").count().collect()]
            # a checkpoint before every segment but an entity's first, and none elsewhere
            assert max(sizes) == hist.every and cp.count() == len(sizes) - patches.select("e").distinct().count()
            got = hist.validity(cp, patches).withColumns({k: F.timestamp_micros(k).cast("timestamp_ntz") for k in ("valid_from", "valid_to")}).collect()
            assert len(got) == len(want) and {(r["e"], r["tier"], r["valid_from"], r["valid_to"]) for r in got} == want

    def test_as_of_with_several_attributes(self, spark):
        rows = self.rows(600, 8)
        hist = EntityHistory(attributes=("tier", "email"), every=5)
        moment = T0 + timedelta(hours=211)
        cp, patches = hist.build(spark.createDataFrame(rows, CUSTOMERS))
        us = int((moment - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        got = {(r["e"], r["tier"], r["email"]) for r in hist.as_of(cp, patches, us).collect()}
        want = set()
        for c, s in self.states(rows).items():
            upto = [x for x in s if x[0] <= moment]
            if upto and not upto[-1][3]:
                want.add((c, upto[-1][1], upto[-1][2]))
        assert got == want

    def test_empty(self, spark):
        hist = EntityHistory()
        assert hist.validity(*hist.build(spark.createDataFrame([], CUSTOMERS))).count() == 0


def test_positions_of_hot_group(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), (F.col("id") * 7919 % 5003).alias("x"))
    got = positions(df, ["k"], [F.col("x")], parts=7).orderBy("pos").collect()
    xs = [r["x"] for r in got]
    assert [r["pos"] for r in got] == list(range(5000)) and xs == sorted(xs)
