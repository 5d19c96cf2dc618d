import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from barloom.operators import ledger
from barloom.sources import bars, store
from barloom.streaming import ledger as streams
from tests.helpers import same
from tests.test_reference_values import random_fills


def test_read_bars_from_csv_folder(spark, tmp_path):
    for name, n in (("AAA", 3), ("BBB", 1)):
        lines = ["date,open,high,low,close,volume"] + [f"2020-01-0{i + 1},1,2,0.5,{i + 1.5},{'' if i else 100}" for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    got = bars.read_bars(spark, str(tmp_path)).toPandas()
    assert len(got) == 4 and set(got.symbol) == {"AAA", "BBB"} and got.volume.isna().sum() == 2
    assert set(bars.read_bars(spark, str(tmp_path), min_rows=2).toPandas().symbol) == {"AAA"}
    bars.read_bars(spark, str(tmp_path)).write.parquet(str(tmp_path / "pq"))
    same(bars.read_bars(spark, str(tmp_path / "pq"), "parquet"), got)


def test_merge(spark):
    row = ("A", dt.date(2020, 1, 1), 1.0, 2.0, 0.5, 1.5, 10.0)
    a = spark.createDataFrame([row], bars.KEYED_SCHEMA)
    assert bars.merge_symbols(a, a.select(*reversed(a.columns))).count() == 2


def test_predictions_and_params_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("A", 1, 0.5), ("B", 2, 0.25)], "symbol string, fold int, pred double")
    for fmt in ("parquet", "csv", "json"):
        store.write_predictions(d, str(tmp_path / fmt), fmt, ["fold"])
        back = spark.read.option("header", True).format(fmt).load(str(tmp_path / fmt))
        assert back.count() == 2 and set(back.columns) == {"symbol", "fold", "pred"}
    p = spark.createDataFrame([("x", 1.0, 2.0), ("y", 3.0, 4.0)], "feature string, mean double, std double")
    packed = store.pack_feature_params(p)
    store.save_feature_params(packed, str(tmp_path / "params"))
    same(store.unpack_feature_params(store.load_feature_params(spark, str(tmp_path / "params"))), p, ("feature",))


def test_tidy_wide(spark):
    d = spark.createDataFrame([(1, 2.0, 5.0, None), (2, None, None, None)], "date int, `Adj Close|A` double, `Volume|A` double, `Close|B` double")
    got = bars.tidy_wide_quotes(d).collect()
    assert len(got) == 1 and got[0]["symbol"] == "A" and got[0]["close"] == 2.0 and got[0]["volume"] == 5.0


def drain(query_df, name, mode="update"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_positions_equal_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(*f, 0.0, start + dt.timedelta(seconds=f[2])) for f in random_fills(300)]
    schema = "account string, symbol string, seq bigint, side string, qty double, price double, filled_qty double, ts timestamp"
    batch = spark.createDataFrame(rows, schema)
    for i in range(3):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(streams.stream_positions(live, "1 hour"), "books")
    out = spark.table("books").toPandas()
    out = out.loc[out.groupby(["account", "symbol"])["n_fills"].idxmax()]
    same(out, ledger.fills_to_positions(batch), ("account", "symbol"), 1e-6)


def test_stream_positions_in_any_order_of_arrival(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(*f, 0.0, start + dt.timedelta(seconds=f[2])) for f in random_fills(300)]
    schema = "account string, symbol string, seq bigint, side string, qty double, price double, filled_qty double, ts timestamp"
    mixed = [rows[i] for i in np.random.default_rng(3).permutation(300)]
    late = [(r[0], r[1], 10_000 + r[2], "buy", 1.0, 1.0, 0.0, start - dt.timedelta(days=365)) for r in rows[:3]]
    for part in (mixed[:100], mixed[100:200] + mixed[:40], mixed[200:], late + mixed[150:170]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(streams.stream_positions(live, "1 hour"), "mixed_books")
    out = spark.table("mixed_books").toPandas()
    out = out.loc[out.groupby(["account", "symbol"])["n_fills"].idxmax()]
    same(out, ledger.fills_to_positions(spark.createDataFrame(rows, schema)), ("account", "symbol"), 1e-6)


def test_stream_orders_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    start = dt.datetime(2024, 1, 1)
    names = ["pending", "partially_filled", "filled"]
    rows = [(int(rng.integers(20)), names[rng.integers(3)], start + dt.timedelta(minutes=int(i))) for i in range(200)]
    schema = "order_id bigint, status string, updated_at timestamp"
    for i in range(4):
        spark.createDataFrame(rows[i * 50:(i + 1) * 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(streams.stream_order_states(live), "orders_now")
    out = spark.table("orders_now").toPandas()
    out = out.loc[out.groupby("order_id")["updated_at"].idxmax()]
    same(out, ledger.latest_order_state(spark.createDataFrame(rows, schema)), ("order_id",))


def test_late_fills(spark):
    d = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, timestamp'2024-01-01 00:20:00' AS arrived_at")
    assert streams.late_fills(d).count() == 1 and streams.late_fills(d, "1 hour").count() == 0


def test_bars_normalize(spark):
    d = spark.sql("SELECT map('A', array(named_struct('timestamp', 1, 'close', 2.0)), 'B', array()) AS data")
    assert [tuple(r) for r in ledger.bars_normalize(d.withColumn("data", F.expr("map_filter(data, (k, v) -> size(v) > 0)"))).collect()] == [("A", 1, 2)]
