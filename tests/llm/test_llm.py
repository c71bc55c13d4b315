"""Rank summaries, leaks, source mixes and residue against brute force and edge cases."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import rank_summaries as rs
from millrace.llm.leaks import LeakScan, myers, words
from millrace.llm.residue import END, ResidueFilter, ResidueIndex, prose
from millrace.llm.tokens import split
from millrace.llm.source_mix import SourceMix, fit, knapsack

T0 = datetime(2024, 1, 1)


# rank summaries
@pytest.mark.parametrize("seed", range(6))
def test_summary_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    xs = [np.sort(rng.integers(0, [5, 50, 10**6][seed % 3], rng.integers(1, 4000)).astype(float)) for _ in range(9)]
    parts = [rs.build(x, 0.01) for x in xs]
    tree = rs.merge([rs.merge(parts[:4], 0.01), rs.merge(parts[4:], 0.01)], 0.01)
    everything = np.sort(np.concatenate(xs))
    v, lo, hi, n = tree
    assert n == len(everything)
    # every tuple's interval meets the ranks its value really has
    first, last = np.searchsorted(everything, v, "left") + 1, np.searchsorted(everything, v, "right")
    assert (lo <= last).all() and (hi >= first).all() and (lo <= hi).all()
    assert rs.bound(tree) <= 3 * 0.01 * n + 2 and len(v) <= 53
    for q in (0, 0.01, 0.5, 0.9, 0.99, 1):
        x, e = rs.quantile(tree, q)
        r = max(1, int(np.ceil(round(q * n, 9))))
        assert np.searchsorted(everything, x, "left") + 1 - e <= r <= np.searchsorted(everything, x, "right") + e and e <= rs.bound(tree)


MODELS = "execution_id long, model_name string, started_at timestamp_ntz, duration_ms long, grp string, day string, n string, v string"


def executions(n, seed=1):
    rng = random.Random(seed)
    out = [(i, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), T0 + timedelta(hours=rng.randrange(90)) if rng.random() > 0.05 else None, rng.choice([None, -1, int(rng.lognormvariate(6, 1))]), "g", "d", "n", "v") for i in range(n)]
    return out + out[: n // 20] + [(None, "a", T0, 5, "g", "d", "n", "v")]


def test_percentiles_and_combining_days(spark):
    rows = executions(5000)
    df = spark.createDataFrame(rows, MODELS)
    r = rs.RankSummaries(eps=0.01)
    daily = r.daily(df)
    got = {x["grp"]: x for x in r.percentiles(r.merged(daily)).collect()}
    values = {}
    for i, g, _, x, *_ in set(rows):
        if i is not None and g and x is not None and x >= 0:
            values.setdefault(g, []).append(x)
    assert set(got) == set(values)
    for g, xs in values.items():
        xs = np.sort(xs)
        assert got[g]["n"] == len(xs) and got[g]["rank_error"] <= got[g]["rank_error_bound"] <= 0.06 * len(xs) + 6
        for c, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
            k = int(np.ceil(q * len(xs)))
            e = got[g]["rank_error_bound"]
            assert xs[max(0, k - 1 - e)] <= got[g][c] <= xs[min(len(xs) - 1, k - 1 + e)]
    days = r.percentiles(daily).collect()
    assert sum(x["n"] for x in days) == sum(map(len, values.values())) and any(x["day"] is None for x in days)
    assert all(all(x[c] for c in ("n_exact", "p50_within", "p90_within", "p99_within")) for x in r.rank_check(df, r.percentiles(r.merged(daily))).collect())
    assert r.percentiles(r.merged(r.daily(df.limit(0)))).count() == 0


def test_summaries_do_not_depend_on_the_order_of_arrival(spark):
    r, rng = rs.RankSummaries(eps=0.01, shards=2), np.random.default_rng(2)
    x = rng.lognormal(6, 1, 60_000).astype(int)
    rows = spark.createDataFrame([(i, "m", T0, int(v)) for i, v in enumerate(x)], "execution_id long, model_name string, started_at timestamp_ntz, duration_ms long")
    a = r.daily(rows).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1777")
    try:
        b = r.daily(rows.orderBy(F.rand(3))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert a == b and a[0]["n"] == 60_000


# leaks
def anchored(p, t, least, rate):
    """Whether a beginning of p is within its budget of a beginning of t, both ending with the same word."""
    row = list(range(len(t) + 1))
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
        if i >= least and any(row[j] <= i // rate and t[j - 1] == a for j in range(1, len(t) + 1)):
            return True
    return False


def test_myers_equals_dynamic_programming():
    rng = np.random.default_rng(4)
    for m, least in ((10, 10), (20, 20), (45, 20), (63, 30)):
        p = rng.integers(1, 4, (150, m))
        t = np.concatenate([p, np.zeros((150, m // 10), int)], axis=1)
        for row in t:  # replaced, dropped and inserted words
            for _ in range(rng.integers(0, 9)):
                k = rng.integers(0, m)
                row[:] = [lambda: np.r_[row[:k], 9, row[k + 1 :]], lambda: np.r_[np.delete(row, k), 0], lambda: np.insert(row, k, 9)[:-1]][rng.integers(0, 3)]()
        n = rng.integers(least, m + 1, 150)
        want = [anchored(a[:x].tolist(), b.tolist(), least, 10) for a, b, x in zip(p, t, n)]
        assert myers(p, t, n, least, 10).tolist() == want and 0 < sum(want) < 150


def test_longest_passage_that_holds_no_shorter_one():
    rng = random.Random(12)
    scan = LeakScan()
    good = lambda ok: ok[0] and ok[-1] and len(ok) >= scan.least and 10 * (len(ok) - sum(ok)) <= len(ok)
    for _ in range(300):
        n = rng.randrange(scan.longest + 1, 90)
        ok = [True] * n
        for i in rng.sample(range(1, n - 1), n // 10):
            ok[i] = False
        assert any(good(ok[s:e]) for s in range(n) for e in range(s + 20, min(n, s + scan.longest) + 1))


@pytest.mark.parametrize(("size", "at", "how", "want"), [(24, 12, "insert", True), (24, 12, "drop", True), (24, 9, "replace", True), (60, 30, "insert", True), (20, 3, "drop", True), (17, 3, "replace", False), (12, 5, "insert", False)])
def test_inserted_and_dropped_words(spark, size, at, how, want):
    item = [f"w{i}" for i in range(80)]
    ws = item[10 : 10 + size]
    ws = {"insert": [*ws[:at], "zzz", *ws[at:]], "drop": [*ws[:at], *ws[at + 1 :]], "replace": [*ws[:at], "zzz", *ws[at + 1 :]]}[how]
    df = spark.createDataFrame([(1, "x y z " + " ".join(ws) + " x y z")], "doc_id long, text string")
    got = LeakScan().found(df, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == ([(1, 5)] if want else [])


def test_words():
    assert words('A <b class="x">bold</b> [link](http://a.b/c) &amp; l’été\u00a0d\u00adeux "don\'t" x_y') == [w.encode() for w in "a bold link lété deux dont x y".split()]
    assert split("a_b c", underscore=True) == [b"a_b", b"c"] and words("") == []


def test_leaks(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, ("Answer the question below. " if i < 3 else "") + " ".join(rng.choice(vocab) for _ in range(60)) + ".") for i in range(8)]
    items += [(90, "too short to leak"), (91, None), (92, "")]
    body = {i: [w.decode() for w in words(t.removeprefix("Answer the question below. "))] for i, t in items[:8]}
    filler = lambda n: [rng.choice([f"f{i}" for i in range(300)]) for _ in range(n)]

    def doc(passage, markup=False):
        if markup:
            passage = [f"**{w.upper()}**," if k % 3 == 0 else f"<b>{w}</b>\n> " if k % 5 == 0 else w for k, w in enumerate(passage)]
        return " ".join([*filler(30), *passage, *filler(30)])

    def replaced(ws, n):
        ws = list(ws)
        for k in rng.sample(range(1, len(ws) - 1), n):
            ws[k] = "zzz"
        return ws

    docs, want = [], set()
    for k in range(40):
        i = rng.randrange(8)
        size = rng.choice([12, 19, 20, 25, 40, 60])
        a = rng.randrange(60 - size + 1)
        ws = body[i][a : a + size]
        n = rng.choice([0, size // 10]) if size >= 20 else 0
        docs.append((k, doc(replaced(ws, n), k % 2 == 0)))
        if size >= 20:
            want.add((k, i))
    docs += [(100, None), (101, ""), (102, "Answer the question below. " * 30), (103, " ".join(filler(50_000)) + " " + " ".join(body[4]) + " " + " ".join(filler(50_000))), docs[0]]
    want.add((103, 4))
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, item_id string, words string")
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    for scan in (LeakScan(), LeakScan(block=16), LeakScan(bloom_bits=64)):  # a full filter only costs time
        got = scan.found(df, it).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert LeakScan().found(df, it.limit(0)).count() == 0 and LeakScan().found(df.limit(0), it).count() == 0


# source mix
def test_knapsack_is_exact():
    rng = random.Random(7)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), rng.randrange(1, 6))
        counts = [rng.randrange(0, 5) for _ in lengths]
        target = rng.randrange(0, 150)
        sums = {0}
        for ln, c in zip(lengths, counts):
            sums = {s + k * ln for s in sums for k in range(c + 1)}
        got = knapsack(lengths, counts, target)
        assert all(n <= counts[lengths.index(a)] for a, n in got.items())
        assert sum(a * n for a, n in got.items()) == max(s for s in sums if s <= target)


def test_fit_hits_the_budget():
    rng = np.random.default_rng(8)
    lengths = np.unique(rng.integers(1, 800, 300))
    counts = rng.integers(1, 60, len(lengths))
    have = int((lengths * counts).sum())
    for budget in (0, 1, 777, have // 3, have, int(2.5 * have), 10 * have):
        passes, extra = fit(lengths, counts, budget, 4)
        assert all(n <= counts[np.searchsorted(lengths, a)] for a, n in extra.items()) and (passes < 4 or not extra)
        got = passes * have + sum(a * n for a, n in extra.items())
        assert got == min(budget, 4 * have) or budget < 800 and got <= budget


def test_mix(spark):
    rng = random.Random(9)
    docs = []
    for i in range(900):
        s = rng.choice(["Guides", "guides ", "GUIDES", "run-logs", "run_logs", "chat", None, "other"])
        docs.append((i, rng.choice([None, "", *["word " * rng.randrange(1, 60)] * 8]), s, "x", "y"))
    docs += docs[:30] + [(None, "a", "chat", "x", "y"), (5000, "long " * 60_000, "other", "x", "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string, repeats string")
    targets = spark.createDataFrame([("guides", 0.5, 1), ("Run_Logs", 0.2, 3), ("chat", 0.2, 4), ("forum", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = SourceMix()
    sel, shares = mix.select(df, targets)
    sel, shares = sel.collect(), {r["source"]: r for r in shares.collect()}
    cap = {"guides": 1, "run_logs": 3, "chat": 4}
    assert len({r["doc_id"] for r in sel}) == len(sel) and all(1 <= r["repeats"] <= cap[r["source"]] and r["tokens"] > 0 for r in sel)
    total = sum(r["tokens"] * r["repeats"] for r in sel)
    for s in cap:
        got = sum(r["tokens"] * r["repeats"] for r in sel if r["source"] == s)
        assert got == shares[s]["tokens_taken"] and abs(got - shares[s]["budget"]) <= 60
        assert shares[s]["actual_share"] == pytest.approx(got / total) and abs(got / total - shares[s]["share"]) < 0.01
    assert shares["forum"]["tokens_taken"] == 0 and shares["guides"]["share"] == pytest.approx(0.5 / 0.9)
    again = mix.select(df.repartition(7), targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, sel))
    small = SourceMix(total=500).select(df, targets)[1].collect()
    assert sum(r["tokens_taken"] for r in small) <= 500
    assert mix.select(df.limit(0), targets)[0].count() == 0 and mix.select(df, targets.limit(0))[0].count() == 0


# residue
REAL = "The loader reads every file once and keeps one row for each key. Late files are accepted for nine days after closing. We compared both branches and found no difference in the totals."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (REAL, False),
        ("You need to enable JavaScript to run this app.", True),
        ("Menu  Search  Help\n\n# orders\n\n404 The page you asked for does not exist. It may have been moved or its name was mistyped.\n\nBack to top", True),
        ('{"error": {"message": "Too many requests from your address. Slow down and retry after 12 seconds.", "id": "72120eba"}}', True),
        ("<html><head><title>Error</title></head><body><h1>503 Service unavailable. We are doing maintenance and will be back soon.</h1></body></html>", True),
        (REAL + "\n\nVisitors saw this message: \"You need to enable JavaScript to run this app.\" It came from a stale bundle.", False),
        ("We replaced the lorem ipsum in the demo seeds by made-up product names that mean something to our readers.", False),
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", True),
        (REAL + "\n\nThe column [COLUMN] was renamed to [NEW COLUMN] in the [DATE] release.", True),
        ("Hello {{ first_name }}, your run of {{ model }} ended.", True),
        (REAL + "\n\nTemplates use `{{ model }}` and `${STATUS}` for this.", False),
        (REAL + "\n\n```sql\nSELECT * FROM {{ ref('x') }} WHERE d = '${DAY}'\n```", False),
        ("The column null was renamed to null in the null release.", True),
        (REAL + "\n\nA sentence about NULL handling is still TBD, and the loader keeps one row for each key that is not null.", False),
        (REAL + "\n\nIt printed \"Hello {{ first_name }}, your run of {{ model }}\" because the engine was off.", False),
        (REAL + "\n\nThe form said “Dear [NAME], your order [NUMBER] has shipped” until the loader was repaired.", False),
        ("Dear [NAME],\n\nyour order [NUMBER] has shipped on <DATE>.", True),
        # everyday texts that are no exemplars
        ("Whoops, the page you were looking for doesn't exist. You may have mistyped the address.", True),
        ("This service is unavailable due to maintenance. Please try again in a few minutes.", True),
        ("We're sorry, an internal error occurred while the server was processing your request.", True),
        ("JavaScript appears to be disabled. Please enable JavaScript in your browser to view this site.", True),
        ("Sorry, you don't have permission to view this page. Contact the administrator.", True),
        ("Diese Seite wurde nicht gefunden. Bitte überprüfen Sie die Adresse.", True),
        ("Placeholder text. Your text goes here. Placeholder text.", True),
        ("2019-01-25 03:38:42 INFO quarantine 8991 rows: invoice_ref is null\n2019-01-25 03:38:44 INFO quarantine 3 rows: sku is null", False),
        ("Menu  Search  Help\n\nBack to top", False),
        ("", False),
        ("   \n\n", False),
        ("## What changed\n<!-- describe your change -->\n\n## Why\n<!-- link the issue -->\n\n## How was it tested\n- [ ] unit\n- [ ] manual", True),
        (" ".join([REAL] * 400) + "\n\nReplace @@project@@ by @@owner@@ before @@date@@.", True),
    ],
)
def test_residue_cases(spark, text, want):
    others = [(i, f"Row {i}: {REAL}") for i in range(2, 40)]
    df = spark.createDataFrame([(1, text), (1, text), *others], "doc_id long, text string")
    got = [r["doc_id"] for r in ResidueFilter().found(df).collect()]
    assert got == ([1] if want else [])


def test_containment_of_blended_exemplars():
    i = ResidueIndex([("error", "alpha beta"), ("error", "gamma delta"), ("form", "alpha gamma"), ("unfilled", "‹mark›")])
    i.weigh({}, 10)
    assert i.score(["alph", "beta", "gamm", "delt"]) == {"error": pytest.approx(1), "form": pytest.approx(0.5)}
    assert i.score(["\x01", "\x01", "x", "y"])["unfilled"] == pytest.approx(0.5) and i.score(["x"]) == {}


def test_residue_tables(spark):
    df = spark.createDataFrame([(1, "You need to enable JavaScript to run this app.", "a", 0.5), (2, None, "b", 0.5), (None, "x", "c", 0.5), (3, REAL, "d", 0.5)], "doc_id long, text string, label string, coverage double")
    f = ResidueFilter()
    kept = f.clean(df).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([2, None, 3]) and kept[0].__fields__ == df.columns
    assert f.found(df.limit(0)).count() == 0
    assert prose("`x {{ y }}`") == [b"\x05"] and prose("a {{ y }}\nb") == [b"a", b"\x01", b"\x05", b"b", b"\x05"] and END < 0


def test_very_long_text_and_ties(spark):
    r = rs.RankSummaries()
    same = spark.range(3000).select(F.col("id").alias("execution_id"), F.lit("m").alias("model_name"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(7).alias("duration_ms"))
    x = r.percentiles(r.merged(r.daily(same))).first()
    assert (x["n"], x["p50"], x["p99"]) == (3000, 7.0, 7.0)
