"""The data source of landed files, and the forward ledger as a stream."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sextant.plans.queries_forward import kind
from sextant.sources import providers
from sextant.sources.providers import Landed, NotProvided, Provider
from sextant.streaming import bars, ledger
from sextant.streaming.ledger import Rules, batch_ledger, streaming_ledger

SF = "/root/testdata/sf0.001"


def landed(spark, **options):
    providers.register(spark)
    return spark.read.format("landed").options(**options)


def test_capabilities_are_explicit(spark):
    star = providers.provider("star")
    assert star.capabilities() == ["trades", "ticks"]
    with pytest.raises(NotProvided, match="does not provide option_quotes_eod"):
        star.landed("option_quotes_eod")
    with pytest.raises(Exception, match="does not provide daily_bars"):
        landed(spark, provider="star", capability="daily_bars", root=SF).load().count()
    with pytest.raises(Exception, match="does not have so"):
        landed(spark, provider="star", capability="ticks", root=SF).schema("user_id string").load().count()
    with pytest.raises(ValueError, match="unknown"):
        Provider("x", "REAL", {"weather": Landed("w", "t int")})
    with pytest.raises(KeyError):
        providers.provider("nobody")


def test_filters_reach_the_files(spark, tmp_path):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(90)]
    table = pa.table({"symbol": pa.array([None if i % 13 == 0 else f"S{i % 7}" for i in range(90)]), "session": days, "close": [float("nan") if i == 80 else float(i) for i in range(90)], "volume": pa.array(range(90), pa.int64())})
    (tmp_path / "bars").mkdir()
    pq.write_table(table, tmp_path / "bars/a.parquet", row_group_size=30)
    (tmp_path / "bars/b.csv").write_text("symbol,session,close,volume,more\nS1,2024-02-01,7.5,100,x\n,2024-05-01,1,,y\n")
    source = Landed("bars", "symbol string, session date, close double, volume bigint")
    reader = providers.LandedReader(f"{tmp_path}/bars", source.typed())
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    left = list(reader.pushFilters([GreaterThan(("volume",), 59), LessThanOrEqual(("close",), 1.0)]))
    assert [type(f) for f in left] == [LessThanOrEqual]  # floating point stays with Spark
    assert [(p.path[-9:], p.group) for p in reader.partitions()] == [("a.parquet", 2), ("ars/b.csv", -1)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 31
    assert reader._may_hold(pq.ParquetFile(tmp_path / "bars/a.parquet").metadata.row_group(0)) is False


@pytest.mark.parametrize("where", ["user_id >= 5 AND event_type IN ('view', 'click')", "ts < TIMESTAMP_NTZ '2024-01-10' AND value > 50", "event_type LIKE 'er%' AND user_id IS NOT NULL", "value <= 3.5 OR user_id = 2", "true"])
def test_source_equals_spark(spark, where):
    got = landed(spark, provider="star", capability="ticks", root=SF).load().where(where)
    want = spark.read.parquet(f"{SF}/events.parquet").where(where)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_missing_folder_is_an_error_and_an_empty_one_is_empty(spark, tmp_path):
    (tmp_path / "lineitem.parquet").mkdir()
    assert landed(spark, provider="star", capability="trades", root=str(tmp_path)).load().count() == 0
    with pytest.raises(Exception, match="nowhere"):
        landed(spark, provider="star", capability="trades", root="/nowhere").load().count()


T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def test_ledger_rules(spark):
    """Opens at a fresh quote, closes at the next one's, expires, refuses; what comes at the same time goes by id."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(1, at(0), 1, "quote", 10.0), (1, at(1), 2, "open", None), (1, at(1), 3, "open", None), (1, at(5), 4, "close", None), (1, at(5), 5, "quote", 11.0), (1, at(5), 6, "close", None), (1, at(9), 7, "open", None),
            (1, at(9), 8, "quote", 12.0), (1, at(9), 9, "open", None), (1, at(30), 10, "open", None), (2, at(0), 11, "close", None), (2, at(1), 12, "quote", None), (2, at(1), 13, "open", None), (None, at(2), 14, "open", None)]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp, id bigint, kind string, price double")
    got = {(r["k"], r["opened_at"], r["status"]): (r["entry"], r["exit"], r["closed_at"]) for r in batch_ledger(df, "k", "ts", "id", F.col("kind"), "price", Rules(3 * 3600, 8 * 3600)).collect()}
    naive = lambda h: at(h).replace(tzinfo=None)
    assert got == {(1, naive(1), "CLOSED"): (10.0, 11.0, naive(5)), (1, naive(9), "REFUSED"): (None, None, None), (1, naive(9), "EXPIRED"): (12.0, None, naive(17)), (1, naive(30), "REFUSED"): (None, None, None), (2, naive(1), "REFUSED"): (None, None, None)}


def test_ledger_stream_equals_batch(spark, tmp_path):
    """Files of events out of order: the stream's rows are the batch's, up to the watermark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ledger.ROCKS)
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = events.orderBy(F.xxhash64("event_id")).toPandas().sort_values("ts", key=lambda t: t.dt.floor("6h"), kind="stable")
    for i in range(4):  # within six hours in any order
        part = rows.iloc[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        pq.write_table(pa.Table.from_pandas(part, preserve_index=False), tmp_path / f"{i}.parquet", coerce_timestamps="us")
    rules = Rules(2 * 86_400, 5 * 86_400)
    folder = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    try:
        made = bars.run_to_table(streaming_ledger(folder, "user_id", "ts", "event_id", kind(), "value", rules, "12 hours"), "ledger_stream", "append").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = int(events.where(kind().isNotNull()).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0])
    until = (last // 1000 - 12 * 3_600_000) * 1000
    want = batch_ledger(events, "user_id", "ts", "event_id", kind(), "value", rules, until).collect()
    assert len(want) > 50 and sorted(map(str, made)) == sorted(map(str, want))
    assert {r["status"] for r in want} == {"CLOSED", "EXPIRED", "REFUSED"}


def test_artifacts_are_written_once(spark, tmp_path):
    from sextant.sources.store import Artifacts, DataProblem

    a = Artifacts(spark, str(tmp_path))
    df = spark.createDataFrame([(dt.date(2024, 1, i + 1), 0.01 * i) for i in range(5)], "session date, ret double")
    ref = a.save("exp-1", "returns", df)
    assert ref["path"] == "exp-1/returns" and ref["rows"] == 5 and sorted(a.load(ref).collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="exists"):
        a.save("exp-1", "returns", df)
    with pytest.raises(DataProblem, match="has changed"):
        a.load(ref | {"hash": "0"})
    df.limit(1).write.mode("append").parquet(str(tmp_path / "exp-1/returns"))
    with pytest.raises(DataProblem):
        a.load(ref)


def test_fills_come_after_what_is_known(spark):
    from sextant.operators import pit

    day = lambda i: dt.date(2024, 1, i)
    at = lambda i, h: dt.datetime(2024, 1, i, h)
    fills = spark.createDataFrame([(day(i), at(i, 9)) for i in (2, 3, 5)], "session date, fill_at timestamp")
    good = spark.createDataFrame([(day(2), at(2, 21)), (day(2), None), (day(3), at(5, 8)), (day(5), at(9, 9))], "session date, available_at timestamp")
    assert pit.timing_violations(good, fills).count() == 0
    pit.assert_timing(good, fills)
    bad = good.union(spark.createDataFrame([(day(3), at(5, 9))], good.schema))
    assert [r["session"] for r in pit.timing_violations(bad, fills).collect()] == [day(3)]
    with pytest.raises(pit.LookAheadError, match="2024-01-03"):
        pit.assert_timing(bad, fills)
