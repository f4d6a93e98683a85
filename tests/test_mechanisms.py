"""Sources, sinks, streams, table functions and tables in pages: damage, replays, late rows, spans and plans."""

import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import generators, stats
from tidemark.plans import components, files
from tidemark.sources import archives, html_tables, storage
from tidemark.streaming import jobs, state

# Published versions and last values


def test_versions_are_whole_single_and_expire(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    with pytest.raises(ValueError, match="nothing is published"):
        storage.published(spark, path)
    for v in (1, 2, 10):
        storage.publish(spark.createDataFrame([(v,)], "v int"), path, v)
    assert storage.versions(spark, path) == [1, 2, 10] and storage.published(spark, path).first()["v"] == 10
    with pytest.raises(ValueError, match="published already"):
        storage.publish(spark.createDataFrame([(3,)], "v int"), path, 10)
    storage.expire(spark, path, 2)
    assert storage.versions(spark, path) == [2, 10] and storage.published(spark, path).first()["v"] == 10
    # A write that was not committed shows nowhere.
    spark.createDataFrame([(99,)], "v int").write.parquet(f"{path}/data-11-lost")
    assert storage.published(spark, path).first()["v"] == 10


def test_last_values_survive_replays_and_late_rows(spark, tmp_path):
    path = f"file://{tmp_path}/last"
    sink = state.keep_last(path, ["k"], ["at"], keep=2)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, at int, v int")
    sink(rows(("a", 5, 1), ("b", 1, 1), ("a", 4, 9)), 0)
    sink(rows(("a", 3, 7), ("b", 2, 2)), 1)
    want = [("a", 5, 1), ("b", 2, 2)]
    read = lambda: sorted(tuple(r) for r in state.last_values(spark, path).collect())
    assert read() == want
    held = state.last_values(spark, path)
    sink(rows(("a", 9, 9)), 1)  # run again with other rows: the version is there, nothing changes
    sink(rows(("a", 9, 9)), 0)
    assert read() == want
    sink(rows(("c", 1, 1)), 2)
    assert read() == [*want, ("c", 1, 1)] and sorted(tuple(r) for r in held.collect()) == want
    sink(rows().limit(0), 3)
    assert read() == [*want, ("c", 1, 1)] and storage.versions(spark, path) == [2, 3]


# Keyed online state


def test_online_levels_of_batches_equal_one_pass(spark, tmp_path):
    rng = np.random.default_rng(5)
    day = 86_400_000_000
    rows = []
    for i in range(400):
        x = float(rng.choice([rng.uniform(2, 140), 500.0, 0.0], p=[0.7, 0.2, 0.1]))
        rows.append((i, (pd.Timestamp("2024-01-01") + pd.Timedelta(int(rng.integers(0, 20 * day)), "us")).to_pydatetime(), int(i % 7), "ab"[i % 2], x, "{}"))
    events = spark.createDataFrame(rows, jobs.EVENTS)
    stream = state.in_batches(events, f"file://{tmp_path}/in", 5)
    with state.state_store(spark):
        got = jobs.run_available(state.online_levels(stream), "test-levels", "append").toPandas()
    assert got["_batch"].nunique() > 2
    given = events.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp"))).toPandas()
    given = given[given["at_us"] // 1000 <= given["at_us"].max() // 1000 - day // 1000]
    want = pd.concat([state.levels_of(g) for _, g in given.groupby("event_type")])
    order = ["event_type", "n"]
    got, want = (f.drop(columns="_batch", errors="ignore").sort_values(order).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
    assert want["trips"].max() > 3 and want["held"].any() and not want["held"].all()


def test_values_wait_in_blocks():
    class Store:
        def __init__(self):
            self.rows, self.sent = [], 0

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows) if isinstance(self.rows, list) else self.rows  # a list, or one value

        def appendList(self, rows):  # noqa: N802
            self.rows, self.sent = self.rows + rows, self.sent + len(rows)

        def put(self, rows):
            self.rows, self.sent = rows, self.sent + len(rows)

        update = put

        def clear(self):
            self.rows = []

        def registerTimer(self, at):  # noqa: N802
            timers.append(at)

    class Clock:
        now = -1

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.now

    timers, p, clock = [], state.OnlineLevels(), Clock()
    p.handle = p.waiting = Store()
    p.value = Store()
    n = 25_000
    at = np.random.default_rng(3).permutation(n) * 1000
    rows = pd.DataFrame({"event_type": "a", "event_id": np.arange(n), "value": np.arange(n) % 170.0, "at_us": at})
    for s in (0, n // 2):
        assert list(p.handleInputRows(("a",), iter([rows[s : s + n // 2]]), clock)) == []
    assert p.waiting.sent < 10 and min(timers) == 0  # not one call's worth for each of 25,000 values
    clock.now = n - 5_001
    got = pd.concat(p.handleExpiredTimer(("a",), clock, None))
    want = state.levels_of(rows[at // 1000 <= clock.now])
    pd.testing.assert_frame_equal(got.reset_index(drop=True), want, check_dtype=False)
    clock.now, before = n, tuple(p.value.rows)
    left = pd.concat(p.handleExpiredTimer(("a",), clock, None))
    assert before[0] == n - 5_000 and left["n"].tolist() == list(range(n - 4_999, n + 1)) and not p.waiting.exists()


def test_the_breaker_opens_cools_and_closes():
    s, held = state.NEW, []
    for at, x in [(0, 5.0), (1, 999.0), (2, 999.0), (3, 5.0), (2 + state.COOL_MS, 6.0), (3 + state.COOL_MS, -1.0), (4 + state.COOL_MS, 7.0)]:
        s, back = state.advance(s, at, x)
        held.append(back)
    assert held == [False, True, True, True, False, True, False] and s[6] == 1 and s[4] == 0


# Archives


def put_zip(path, name, members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for k, text in members.items():
            z.writestr(k, text)
    (path / name).write_bytes(held.getvalue())
    return held.getvalue()


def test_damaged_archives_are_named_and_others_read(spark, tmp_path):
    import hashlib

    good = put_zip(tmp_path, "good.zip", {"a.csv": "1,2.5,x\n2,,y\n", "b.csv": "3,oops,z\n4\n", "empty.csv": ""})
    (tmp_path / "good.zip.CHECKSUM").write_text(hashlib.sha256(good).hexdigest() + "  good.zip")
    put_zip(tmp_path, "wrong.zip", {"a.csv": "9,9,9\n"})
    (tmp_path / "wrong.zip.CHECKSUM").write_text("0" * 64)
    (tmp_path / "broken.zip").write_bytes(b"this is no archive")
    torn = bytearray(put_zip(tmp_path, "torn.zip", {"a.csv": "7,7.0,q\n" * 5000}))
    torn[60:70] = b"\0" * 10
    (tmp_path / "torn.zip").write_bytes(torn)
    spark.dataSource.register(archives.ZippedCsv)
    read = lambda schema, **o: spark.read.format("zipped_csv").schema(schema).option("names", "id,price,name").options(**o).load(f"file://{tmp_path}")
    rows = read("id long, price double, _archive string, _error string").collect()
    assert sorted((r["id"], r["price"]) for r in rows if r["_archive"] == "good.zip") == [(1, 2.5), (2, None), (3, None), (4, None)]
    errors = {r["_archive"]: r["_error"] for r in rows if r["_error"]}
    assert set(errors) == {"wrong.zip", "broken.zip", "torn.zip"} and "checksum" in errors["wrong.zip"]
    assert all(r["id"] is None for r in rows if r["_error"])
    assert read("name string").where("name = 'z'").count() == 1
    with pytest.raises(Exception, match="wrong.zip|broken.zip|torn.zip"):
        read("id long", mode="FAILFAST").collect()
    one = read("price double")
    assert one.columns == ["price"]


def test_archives_go_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 2.5), ("y", 2, None), ("x", 3, -1.0)], "a string, id long, v double")
    archives.write_archives(df, f"file://{tmp_path}/z", "a")
    spark.dataSource.register(archives.ZippedCsv)
    got = spark.read.format("zipped_csv").schema("id long, v double, _archive string").option("names", "id,v").option("mode", "FAILFAST").load(f"file://{tmp_path}/z")
    assert sorted((r["_archive"], r["id"], r["v"]) for r in got.collect()) == [("x.zip", 1, 2.5), ("x.zip", 3, -1.0), ("y.zip", 2, None)]
    assert got.rdd.getNumPartitions() == 2


def test_archives_of_many_batches_and_nulls_come_back_whole(spark, tmp_path):
    # Whole numbers beside nulls were written as 1.0 when an archive was one frame, and read back as nulls.
    n = F.col("id")
    df = spark.range(25_000).select((n % 2).cast("string").alias("a"), F.when(n % 100 > 0, n).alias("k"), (n / 4).alias("v"), F.concat(F.lit('x, "'), n).alias("s"))
    archives.write_archives(df, f"file://{tmp_path}/z", "a")
    assert sorted(f.name for f in (tmp_path / "z").iterdir()) == ["0.zip", "0.zip.CHECKSUM", "1.zip", "1.zip.CHECKSUM"]
    spark.dataSource.register(archives.ZippedCsv)
    got = spark.read.format("zipped_csv").schema("_archive string, k long, v double, s string").option("names", "k,v,s").option("mode", "FAILFAST").load(f"file://{tmp_path}/z")
    want = df.select(F.concat("a", F.lit(".zip")), "k", "v", "s")
    assert got.count() == 25_000 and got.exceptAll(want).isEmpty()


# Tables in pages


def only(html):
    (grid, heads), *rest = html_tables.html_grids(html)
    assert not rest
    return grid, heads


def test_spans_and_missing_cells():
    grid, heads = only(
        "<table><thead><tr><th rowspan=2>Day<th colspan=2>Flow<tr><th>in<th>out</thead>"
        "<tbody><tr><td rowspan=3>Mon<td>1<td>2<tr><td colspan=2>none<tr><td>5</tbody><tbody><tr><td>Tue<td>7<td>8</tbody></table>"
    )
    assert heads == 2 and html_tables.names(grid, heads) == ["Day", "Flow in", "Flow out"]
    assert grid[2:] == [["Mon", "1", "2"], ["Mon", "none", "none"], ["Mon", "5"], ["Tue", "7", "8"]]


def test_row_spans_end_with_their_group():
    grid, _ = only("<table><tbody><tr><td rowspan=9>a<td>1</tr></tbody><tbody><tr><td>b<td>2</tr></tbody></table>")
    assert grid == [["a", "1"], ["b", "2"]]
    grid, _ = only("<table><tr><td rowspan=0>a<td>1<tr><td>2<tr><td>3</table>")
    assert grid == [["a", "1"], ["a", "2"], ["a", "3"]]


def test_nested_tables_references_and_scripts():
    found = html_tables.html_grids("<table><tr><th>k<th>v<tr><td>x &amp; y<td>1<table><tr><td>inner</table>2<script>var a='<td>';</script></table>")
    assert [g for g, _ in found] == [[["k", "v"], ["x & y", "12"]], [["inner"]]] and found[0][1] == 1
    assert html_tables.html_grids("<table></table><p>") == [([], 0)] and html_tables.html_grids("no table") == []
    assert html_tables.html_grids("<table><td>loose")[0][0] == [["loose"]]


def test_markdown_tables():
    (grid, heads), (plain, none) = html_tables.markdown_grids("text\n| a | b |\n|:--|--:|\n| 1 | x\\|y |\n| 2 |\n\n|p|q|\nend")
    assert heads == 1 and grid == [["a", "b"], ["1", "x|y"], ["2"]] and (plain, none) == ([["p", "q"]], 0)


def test_cells_and_rows(spark):
    pages = [(1, "<table><tr><th>Date<th>A<th>B<tr><td>d1<td>(1,440.3)<td>-<tr><td>d2<td>5</table>"), (2, None), (3, "none"), (4, "|Date|A|B|\n|-|-|-|\n|d3|7||"), (5, "<table><tr><th>other<tr><td>1</table>")]
    cells = html_tables.table_cells(spark.createDataFrame(pages, "id long, html string"), "id", "html")
    rows = html_tables.table_rows(cells, "id", ["Date", "A", "B"])
    got = rows.select("id", "Date", html_tables.number(F.col("A")).alias("a"), html_tables.number(F.col("B")).alias("b")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == [(1, "d1", -1440.3, 0.0), (1, "d2", 5.0, None), (4, "d3", 7.0, 0.0)]
    assert html_tables.table_cells(spark.createDataFrame([], "id long, html string"), "id", "html").count() == 0


# Table functions


def test_folds_equal_the_window_form_without_a_join(spark):
    rows = [(a, pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i)) for a, n in (("a", 53), ("b", 7), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "asset string, d date")
    got = generators.purged_folds(df, 5, 3)
    want = stats.purged_folds(df, "asset", "d", 5, 3).select("asset", "d", "fold", "role")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_block_replicates_surround_the_mean(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 1, 400)
    rows = [("a", pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i), float(v)) for i, v in enumerate(x)] + [("b", pd.Timestamp("2024-01-01").date(), 2.0), ("b", pd.Timestamp("2024-01-02").date(), None)]
    df = spark.createDataFrame(rows, "asset string, d date, x double")
    got = generators.block_replicates(df, 300, 7).toPandas()
    again = generators.block_replicates(df, 300, 7).toPandas()
    means = got[got["asset"] == "a"]["mean"]
    assert len(means) == 300 and abs(means.mean() - x.mean()) < 0.02 and 0.02 < means.std() < 0.1
    assert set(got[got["asset"] == "b"]["mean"]) == {2.0}
    pd.testing.assert_frame_equal(*(f.sort_values(["asset", "replicate"]).reset_index(drop=True) for f in (got, again)))


# Plans of pruned and bucketed tables


def test_pruned_bucketed_join_opens_a_year_and_does_not_shuffle(spark):
    b = spark.range(4000).select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("asset"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") / 3).cast("int")).alias("d"), F.col("id").cast("double").alias("close"))
    names = files.series_tables(spark, b)
    out = files.year_join(spark, *names, 1996)
    assert out.count() == 36
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "PartitionFilters: [isnotnull(year" in plan
    every = spark.table(names[0])
    assert 0 < len(every.where("year = 1996").inputFiles()) <= 4 < len(every.inputFiles())
    for n in names:
        spark.sql(f"DROP TABLE {n}")


# Components


def test_first_component_equals_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, (40, 4)) @ rng.normal(0, 1, (4, 4))
    c = np.corrcoef(a.T)
    df = spark.createDataFrame([([list(map(float, r)) for r in c],), ([[1.0, None], [None, 1.0]],)], "m array<array<double>>")
    got = [r[0] for r in df.select(components.first_component(F.col("m"), 4, 2000).alias("v")).collect()]
    w, v = np.linalg.eigh(c)
    want = v[:, -1] * (1 if v[:, -1].sum() >= 0 else -1)
    assert got[0] == pytest.approx(want, abs=1e-6)


def test_confidence_falls_with_spread_and_correlation(spark):
    rows = [(0.8, 0.1, 0.7, 0.2), (0.4, 0.6, 0.3, 0.9), (0.4, 0.6, 0.3, 0.0), (1.0, 0.0, 1.0, 0.0), (None, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "c double, r double, a double, t double")
    high, low, apart, top, none = (r[0] for r in df.select(components.spread_confidence("c", "r", "a", "t").alias("v")).collect())
    base = 0.8 * 0.9
    assert high == pytest.approx(base - 0.35 * 0.6 * 0.2 * 0.1 + 0.05 * 0.7 * base) and low < apart < high and top == 0.95 and none is None


# The order-level book


def book_by_hand(messages):
    """The book after each day's messages, by a plain loop: {(book, day): {order_id: [side, price, volume, since]}}."""
    state, out = {}, {}
    days = sorted({m[2] for m in messages})
    for day in days:
        for book, seq, d, order, side, price, volume, action in sorted(messages, key=lambda m: m[1]):
            if d != day:
                continue
            own = state.setdefault(book, {})
            if action == "F":
                own.clear()
            elif action == "D":
                own.pop(order, None)
            elif action == "A" or action == "Y" and order not in own:
                own[order] = [side, price, volume, seq]
            elif order in own:
                own[order][1] = own[order][1] if price is None else price
                own[order][2] = own[order][2] if volume is None else volume
        out |= {(b, day): {k: list(v) for k, v in o.items()} for b, o in state.items()}
    return out


def test_order_book_equals_a_loop(spark):
    import datetime
    import random

    from tidemark.operators import book as B

    rng = random.Random(8)
    first = datetime.date(2024, 1, 1)
    messages = []
    for seq in range(900):
        order = rng.randrange(25)
        side = "buy" if order % 2 else "sell"
        price = None if rng.random() < 0.3 else (90.0 if side == "buy" else 100.0) + rng.randrange(8)
        action = rng.choices("AMDYF", [5, 6, 3, 4, 0.1])[0]
        messages.append((order % 3, seq, first + datetime.timedelta(days=seq // 60), order, side, price, None if rng.random() < 0.3 else rng.randrange(1, 9), action))
    df = spark.createDataFrame(messages, "book int, seq long, day date, order_id int, side string, price double, volume long, action string")
    last = max(m[2] for m in messages)
    standing = B.at_day_ends(B.versions(df), F.lit(last))
    got = {}
    for r in standing.collect():
        got.setdefault((r["book"], r["at"]), {})[r["order_id"]] = [r["side"], r["price"], r["volume"], r["since"]]
    want = book_by_hand(messages)
    assert all(got.get(k, {}) == v for k, v in want.items())
    # Levels and measures of one day, by hand.
    key = max(k for k, v in want.items() if {o[0] for o in v.values() if o[1] is not None and o[2]} == {"buy", "sell"})
    sides = {}
    for k, (side, price, volume, since) in want[key].items():
        if price is not None and volume:
            at = sides.setdefault(side, {}).setdefault(price, [0, 0, (10**9, 0)])
            at[0], at[1], at[2] = at[0] + volume, at[1] + 1, min(at[2], (since, k))
    best = {s: sorted(p.items(), reverse=s == "buy")[:3] for s, p in sides.items()}
    ladder = B.levels(standing.where("price IS NOT NULL"))
    rows = ladder.where((F.col("book") == key[0]) & (F.col("at") == F.lit(key[1]))).collect()
    for s, expected in best.items():
        own = sorted((r for r in rows if r["side"] == s), key=lambda r: r["level"])
        assert [(r["price"], r["volume"], r["orders"], r["first_order"]) for r in own] == [(p, v[0], v[1], v[2][1]) for p, v in expected]
    m = B.measures(ladder).where((F.col("book") == key[0]) & (F.col("at") == F.lit(key[1]))).first()
    (bp, (bv, *_)), (sp, (sv, *_)) = best["buy"][0], best["sell"][0]
    assert (m["mid"], m["spread"]) == ((bp + sp) / 2, sp - bp) and m["weighted"] == pytest.approx((bp * sv + sp * bv) / (bv + sv))


def test_change_only_over_many_frames_of_a_user(spark, tmp_path):
    from tidemark.streaming import jobs

    # 25,000 rows of one user come in several frames (of 10,000 rows at most), beside users of a few rows.
    n = F.col("id")
    e = spark.range(25_300).select(
        n.alias("event_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=n)).alias("ts"), F.when(n < 25_000, 1).otherwise(n % 7 + 2).alias("user_id").cast("long"),
        F.lit("view").alias("event_type"), F.floor(n / 3).cast("double").alias("value"), F.lit("{}").alias("props"),
    )
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = jobs.run_available(jobs.change_only(jobs.events_stream(spark, str(tmp_path))), "changes", "append")
    found = {(r["user_id"], r["event_id"], r["v"]) for r in got.collect()}
    want, last = set(), {}
    for k in range(25_300):
        user, v = (1 if k < 25_000 else k % 7 + 2), float(k // 3)
        if last.get(user) != v:
            want.add((user, k, v))
        last[user] = v
    assert found == want and got.count() == len(want)


def test_clearings_take_time_in_proportion_to_messages(spark):
    import time

    from tidemark.operators import book as B

    # One book of 120,000 messages: a frame to its end for each of them would be seven thousand million steps.
    n = F.col("id")
    action = F.when(n % 997 == 5, "F").when(n % 3 == 0, "A").when(n % 3 == 1, "M").otherwise("D")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(n / 5000).cast("int"))
    m = spark.range(120_000).select(F.lit(0).alias("book"), n.alias("seq"), day.alias("day"), (n % 50).alias("order_id"), F.lit("buy").alias("side"), F.lit(1.0).alias("price"), F.lit(1).alias("volume"), action.alias("action"))
    began = time.time()
    got = B._between_clearings(m).agg(F.max("_cleared"), F.sum("_cleared"), F.count_if(F.col("_next_clear").isNull()), F.max("_next_clear")).first()
    took = time.time() - began
    clears = [k for k in range(120_000) if k % 997 == 5]
    assert got[0] == len(clears) and got[1] == sum(120_000 - k for k in clears) and got[2] == 120_000 - clears[-1]
    assert str(got[3]) == "2024-01-24" and took < 20


def test_order_book_clears_across_days(spark):
    import datetime

    from tidemark.operators import book as B

    d = [datetime.date(2024, 1, k) for k in (1, 2, 3, 4)]
    rows = [(1, 1, d[0], "A"), (1, 2, d[0], "F"), (1, 3, d[0], "A"), (1, 4, d[2], "F"), (1, 5, d[2], "F"), (1, 6, d[2], "A"), (2, 7, d[1], "A"), (None, 8, d[1], "A"), (2, 9, None, "F")]
    m = spark.createDataFrame(rows, "book int, seq long, day date, action string")
    got = {r["seq"]: (r["_cleared"], r["_next_clear"]) for r in B._between_clearings(m).collect()}
    assert got == {1: (0, d[0]), 2: (1, d[2]), 3: (1, d[2]), 4: (2, d[2]), 5: (3, None), 6: (3, None), 7: (0, None)}


def test_objects_in_prose(spark):
    from tidemark.plans.book import object_in

    texts = ['{"a": 1}', 'so ```json\n{"a": 2}\n``` yes', 'I say {"a": {"b": 3}} now', "nothing", '{"a": ', None, "", "[1, 2]", 'two {"a": 1} and {"a": 2}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(object_in(F.col("t")).cast("string")).collect()]
    assert got[:3] == ['{"a":1}', '{"a":2}', '{"a":{"b":3}}'] and got[3:] == [None] * 5 + ['{"a":1}']
