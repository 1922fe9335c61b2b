"""Rules of the lake on hand-written rows."""

import datetime as dt
import lzma
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelake.functions import scalars as S
from tidelake.functions import schemas
from tidelake.operators import compact, frontier, migrate, quality, resample, score
from tidelake.plans import ingest, run
from tidelake.sources import chunks, files
from tidelake.streaming import jobs


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def day(text):
    return dt.date.fromisoformat(text)


@pytest.mark.parametrize(("text", "ms"), [("2024-01-01 00:00:00+00:00", 1704067200000), ("2024-06-15 12:30:00.500+00:00", 1718454600500), ("1704067260000", 1704067260000), ("2024-01-01T01:00:00+01:00", 1704067200000), ("2024-01-01 00:00:00", 1704067200000), ("junk", None), (None, None)])
def test_times(spark, text, ms):
    assert one(spark, x=S.to_ms(F.lit(text).cast("string")))["x"] == ms


@pytest.mark.parametrize(("price", "scaled"), [(1.08501, 108501), (1.08498, 108498), (0.000005, 0), (0.000015, 2), (None, None)])
def test_scaling_is_half_even(spark, price, scaled):
    assert one(spark, x=S.scale_price(F.lit(price).cast("double"), F.lit(100_000)))["x"] == scaled


def test_names(spark):
    r = one(
        spark, a=S.timeframes(F.lit("1h, m15,H1,4h")), b=S.month_key(F.lit("EURUSD_tick_2024_02.parquet")), c=S.month_key(F.lit("EURUSD_tick_2024_13.parquet")),
        d=S.canonical_path(F.lit("b"), F.lit("EURUSD"), F.lit("tick"), F.lit("2024_02")), e=S.canonical_path(F.lit("b"), F.lit("EURUSD"), F.lit("h4"), F.lit(None).cast("string")),
        f=S.parquet_path(F.lit("x/y.csv")), g=S.price_text(F.lit(1234.5)), h=S.price_text(F.lit(1.5)), i=S.price_text(F.lit(None).cast("double")), j=S.resolve_factor(F.lit(0), F.lit(7)),
    )
    assert r["a"] == ["h1", "m15", "h4"] and r["b"] == "2024_02" and r["c"] is None
    assert r["d"] == "b/EURUSD/tick/EURUSD_tick_2024_02.parquet" and r["e"] == "b/EURUSD/4h/EURUSD_4h.parquet" and r["f"] == "x/y.parquet"
    assert (r["g"], r["h"], r["i"], r["j"]) == ("1,234.50", "1.5", "--", 7)
    with pytest.raises(Exception, match="unknown timeframe"):
        one(spark, x=S.timeframe(F.lit("2h")))


D1, D2, D3, D4 = (day(f"2024-01-0{i}") for i in range(1, 5))


@pytest.mark.parametrize(("old", "planned", "bad", "want"), [(D1, [D2, D3, D4], D2, D1), (D1, [D2, D3, D4], None, D4), (None, [D1, D2, D3], D1, None), (None, [D1, D2, D3], D3, D2), (D4, [D1, D2], D2, D4)])
def test_frontier_stops_at_gaps(spark, old, planned, bad, want):
    key = ("EURUSD", "tick")
    plan = spark.createDataFrame([(*key, d) for d in planned], "symbol string, timeframe string, dt date")
    done = spark.createDataFrame([(*key, d, d != bad) for d in planned], "symbol string, timeframe string, dt date, ok boolean")
    last = spark.createDataFrame([(*key, old)] if old else [], schemas.CHECKPOINT)
    assert frontier.frontier(plan, done, last).first()["last_date"] == want


def test_missing_outcome_is_a_gap(spark):
    plan = spark.createDataFrame([("A", "tick", d) for d in (D1, D2, D3)], "symbol string, timeframe string, dt date")
    done = spark.createDataFrame([("A", "tick", D1, True), ("A", "tick", D3, True)], "symbol string, timeframe string, dt date, ok boolean")
    assert frontier.frontier(plan, done, spark.createDataFrame([], schemas.CHECKPOINT)).first()["last_date"] == D1


def test_plan_of_months(spark):
    i = spark.createDataFrame([("A", 10, {"h1": day("2023-11-15")})], "symbol string, decimal_factor int, start_dates map<string,date>")
    none = spark.createDataFrame([], schemas.CHECKPOINT)
    as_of = F.lit("2024-01-20").cast("date")
    got = [r["dt"] for r in ingest.build_plan(i, ["h4", "tick"], none, as_of).orderBy("dt").collect()]
    assert got == [day("2023-12-01"), day("2024-01-01")]
    assert ingest.build_plan(i, ["h4"], none, as_of, partial_first_month=True).count() == 3
    assert ingest.build_plan(i, ["h1"], none, F.lit("2023-11-20").cast("date")).count() == 0


def bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, timestamp bigint, open int, high int, low int, close int, volume float")


def test_resample_of_resample_is_resample(spark):
    b = bars(spark, [("A", i * 60_000, i, i + 2, i - 2, i + 1, 1.0) for i in range(500)])
    twice = resample.resample(resample.resample(b, 900_000), 3_600_000)
    assert sorted(twice.collect()) == sorted(resample.resample(b, 3_600_000).collect())
    assert resample.resample(b.limit(0), 900_000).count() == 0
    with pytest.raises(ValueError):
        resample.resample(b, 7_000_000)


def test_compaction_is_idempotent_and_newest_wins(spark, tmp_path):
    cols = "symbol string, timestamp bigint, bid int, seq bigint"
    first = compact.with_month(spark.createDataFrame([("A", 1704067200000, 1, 1), ("A", 1704067200000, 2, 2), ("B", 1709251200000, 5, 3)], cols))
    late = compact.with_month(spark.createDataFrame([("A", 1704067200000, 9, 4), ("A", 1706745600000, 7, 5)], cols))
    path = str(tmp_path / "lake")
    compact.compact(path, first)
    once = sorted(compact.compact(path, late).collect())
    assert sorted(compact.compact(path, late).collect()) == once
    assert sorted(r["bid"] for r in once) == [5, 7, 9]
    kept = compact.merge(first, late, prefer="existing")
    assert sorted(r["bid"] for r in kept.collect()) == [2, 5, 7]
    assert compact.merge(first, late.limit(0)).count() == 2


def test_chunks(spark, tmp_path):
    def blob(*recs):
        return lzma.compress(b"".join(struct.pack(">iiiff", *r) for r in recs), format=lzma.FORMAT_ALONE)

    folder = tmp_path / "EURUSD" / "2024" / "00" / "15"
    folder.mkdir(parents=True)
    (folder / "03h_ticks.bi5").write_bytes(blob((5, 108501, 108499, 1.5, 2.5), (7, 108502, 108498, 0.5, 0.25)))
    (folder / "04h_ticks.bi5").write_bytes(b"")
    (folder / "05h_ticks.bi5").write_bytes(b"not a chunk")
    got = chunks.decode_chunks(chunks.scan_chunks(spark, str(tmp_path)), "tick")
    good, bad = got.where("error IS NULL").drop("path", "error"), got.where("error IS NOT NULL")
    base = 1705287600000
    assert sorted(tuple(r) for r in good.collect()) == [("EURUSD", base + 5, 108501, 108499, 1.5, 2.5), ("EURUSD", base + 7, 108502, 108498, 0.5, 0.25)]
    assert [r["path"].rpartition("/")[2] for r in bad.collect()] == ["05h_ticks.bi5"]
    # bars: seconds, then open, high, low, close; ticks beside them are not read as bars
    (folder / "BID_candles_min_1.bi5").write_bytes(lzma.compress(struct.pack(">iiiiif", 60, 100, 140, 90, 120, 2.5), format=lzma.FORMAT_ALONE))
    (tmp_path / "EURUSD" / "2024" / "00" / "BID_candles_hour_1.bi5").write_bytes(lzma.compress(struct.pack(">iiiiif", 3600, 1, 4, 0, 2, 0.5), format=lzma.FORMAT_ALONE))
    found = chunks.scan_chunks(spark, str(tmp_path))
    m1 = chunks.decode_chunks(found, "m1").drop("path").collect()
    assert [r.asDict() for r in m1] == [{"symbol": "EURUSD", "error": None, "timestamp": 1705276860000, "open": 100, "high": 140, "low": 90, "close": 120, "volume": 2.5}]
    assert [r["timestamp"] for r in chunks.decode_chunks(found, "h1").collect()] == [1704070800000]


def test_written_chunks_are_found(spark, tmp_path):
    rows = spark.createDataFrame([("A", 3_600_005, 5, 4, 1.0, 2.0)], "symbol string, timestamp long, ask int, bid int, ask_vol float, bid_vol float")
    blobs = chunks.encode_chunks(rows.withColumn("base_ms", F.lit(3_600_000).cast("long")), "tick", ["symbol"]).withColumn("key", F.lit("A/1970/00/01/01h_ticks.bi5"))
    for root in (str(tmp_path / "x"), f"file://{tmp_path}/y", f"file:{tmp_path}/z"):
        chunks.write_chunks(blobs, root)
        assert chunks.decode_chunks(chunks.scan_chunks(spark, root), "tick").first()["timestamp"] == 3_600_005


def test_listed_chunks_are_opened_alone(spark, tmp_path):
    """Only files with a chunk's name are listed, and of these only the planned ones are opened; the others hold no chunk."""
    folder = tmp_path / "in" / "a" / "2024" / "00" / "15"
    folder.mkdir(parents=True)
    good = lzma.compress(struct.pack(">iiiff", 5, 2, 1, 1.0, 1.0), format=lzma.FORMAT_ALONE)
    for name, content in {"03h_ticks.bi5": good, "04h_ticks.bi5": b"no chunk", "05h_ticks.bi5": good[:-3], "06h_ticks.bi5": good + good, "07h_ticks.bi5": good + b"xyz", "03h_ticks": good, "note.txt": b""}.items():
        (folder / name).write_bytes(content)
    listed = chunks.list_chunks(spark, str(tmp_path / "in"))
    assert sorted(r["key"] for r in listed.collect()) == [f"A/2024/00/15/0{i}h_ticks.bi5" for i in range(3, 8)]
    got = chunks.decode_listed(listed.where("key NOT LIKE '%04h%'"), "tick").collect()
    assert sorted((r["path"][-13:-11], r["error"] is None) for r in got) == [("03", True), ("05", False), ("06", True), ("06", True), ("07", True)]
    lost = spark.createDataFrame([(str(tmp_path / "none"), "A", 0)], "path string, symbol string, base_ms long")
    assert "FileNotFoundError" in chunks.decode_listed(lost, "tick").first()["error"]


def test_checkpoints_outside_the_plan_stay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    plan = spark.createDataFrame([("A", "m1", day("2024-01-01"), 1)], "symbol string, timeframe string, dt date, decimal_factor int")
    before = spark.createDataFrame([("A", "m1", None), ("A", "tick", day("2023-01-01")), ("B", "m1", day("2023-05-01"))], schemas.CHECKPOINT)
    at = run.ingest(spark, plan, str(tmp_path / "in"), str(tmp_path / "lake"), before, F.lit("2024-01-05").cast("date"), 1)
    assert sorted(map(tuple, at.collect())) == [("A", "m1", day("2024-01-01")), ("A", "tick", day("2023-01-01")), ("B", "m1", day("2023-05-01"))]


def test_a_chunk_of_any_size_takes_bounded_memory():
    """400 MB of records in one chunk, under a limit of 150 MB for what Python allocates meanwhile."""
    import io
    import tracemalloc

    packer = lzma.LZMACompressor(format=lzma.FORMAT_ALONE, preset=0)
    part = np.zeros(1_000_000, chunks.TICK_RECORD)
    part["offset"] = np.arange(1_000_000) % 1000
    blob = b"".join([*(packer.compress(part.tobytes()) for _ in range(20)), packer.flush()])
    decode, _ = chunks._decoder("tick", [], lambda _: io.BytesIO(blob))
    batch = pa.RecordBatch.from_arrays([pa.array(["p"]), pa.array(["A"]), pa.array([0]), pa.array([""])], names=["path", "symbol", "base_ms", "source"])
    tracemalloc.start()
    n = sum(b.num_rows for b in decode(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000_000 and peak < 150_000_000


def test_absent_chunks_can_count_as_bad(spark, tmp_path):
    plan = spark.createDataFrame([("A", "m15", day("2024-01-01"), 1), ("A", "m15", day("2024-01-02"), 1)], "symbol string, timeframe string, dt date, decimal_factor int")
    folder = tmp_path / "in" / "A" / "2024" / "00" / "01"
    folder.mkdir(parents=True)
    (folder / "BID_candles_min_1.bi5").write_bytes(lzma.compress(struct.pack(">iiiiif", 60, 1, 4, 1, 2, 0.5), format=lzma.FORMAT_ALONE))
    none = spark.createDataFrame([], "symbol string, timeframe string, last_date date")
    for ok, last in ((True, "2024-01-02"), (False, "2024-01-01")):
        at = run.ingest(spark, plan, str(tmp_path / "in"), str(tmp_path / f"lake{ok}"), none, F.lit("2024-01-05").cast("date"), 1, absent_ok=ok)
        assert [tuple(r) for r in at.collect()] == [("A", "m15", day(last))]
    run.reconstruct(spark, str(tmp_path / "lakeTrue"), ["a"], ["m15"])
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "lakeTrue" / "m15")).select("symbol", "timestamp", "high").collect()] == [("A", 1704067200000, 4)]


def test_stable_order_and_places_in_files(spark, tmp_path):
    folder = tmp_path / "in" / "A" / "tick"
    folder.mkdir(parents=True)
    lines = [f"2024-01-01 00:00:0{i % 3}+00:00,{i + 1},1,1,1" for i in range(30)]
    (folder / "a.csv").write_text("\n".join(["timestamp,ask,bid,ask_vol,bid_vol", *lines]) + "\n")
    migrate.migrate(spark, str(tmp_path / "in"), str(tmp_path / "out"), "tick", spark.createDataFrame([("A", 1)], "symbol string, decimal_factor int"))
    table = spark.read.parquet(str(tmp_path / "out"))
    got = [r["ask"] for r in table.select("ask", "timestamp", "_metadata.file_path", "_metadata.row_index").orderBy("timestamp", "file_path", "row_index").collect()]
    assert got == [i + 1 for k in range(3) for i in range(k, 30, 3)]
    assert {r["inversions"] for r in quality.file_order(table).collect()} == {0}
    rows = spark.createDataFrame([("A", i, t) for i, t in enumerate([5, 6, 4, 7, 9, 8, 1])], "symbol string, place int, timestamp long")
    for block in (2, 3, 100):
        assert [tuple(r) for r in quality.order(rows, ["symbol"], "place", block).collect()] == [("A", 3, 2)]


def test_migration(spark, tmp_path):
    for name, lines in {"AAA": ["2024-01-01 00:00:02+00:00,1.5,1.4,1,1", "2024-01-01 00:00:00+00:00,1.2,1.1,1,1", "2024-01-01 00:00:00+00:00,1.2,1.1,1,1"], "BBB": [], "CCC": ["soon,1,1,1,1"]}.items():
        folder = tmp_path / "in" / name / "tick"
        folder.mkdir(parents=True)
        (folder / f"{name}_tick.csv").write_text("\n".join(["timestamp,ask,bid,ask_vol,bid_vol", *lines]) + "\n")
    factors = spark.createDataFrame([("AAA", 10)], "symbol string, decimal_factor int")
    dry = migrate.migrate(spark, str(tmp_path / "in"), str(tmp_path / "out"), "tick", factors, dry_run=True)
    assert {r["symbol"]: (r["rows_in"], r["rows_out"], r["status"]) for r in dry.collect()} == {"AAA": (3, 3, "dry_run_ok"), "BBB": (0, 0, "skipped_empty"), "CCC": (1, 0, "error")}
    assert not (tmp_path / "out").exists()
    result = migrate.migrate(spark, str(tmp_path / "in"), str(tmp_path / "out"), "tick", factors)
    assert '"ok":1' in migrate.report(result).first()["value"]
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("symbol", "timestamp", "ask", "bid").orderBy("timestamp").collect()]
    assert got == [("AAA", 1704067200000, 12, 11)] * 2 + [("AAA", 1704067202000, 15, 14)]


def csv_file(root, symbol, lines, name="a"):
    folder = root / symbol / "tick"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.csv").write_text("\n".join(["timestamp,ask,bid,ask_vol,bid_vol", *lines]) + "\n")


def test_bad_files_are_told_and_left_out(spark, tmp_path):
    at = "2024-01-01 00:00:00+00:00"
    csv_file(tmp_path / "in", "GOOD", [f"{at},1.08501,1.08499,1,"])
    csv_file(tmp_path / "in", "WORD", [f"{at},1.5,1.4,1,1", f"{at},n/a,1.4,1,1", f"{at},,1.4,1,1"])
    csv_file(tmp_path / "in", "FAR", [f"{at},30000.5,1.4,1,1"])
    csv_file(tmp_path / "in", "RAW", [f"{at},108501,108499,1,1", f"{at},108502,108498,1,1"])
    csv_file(tmp_path / "in", "MIX", [f"{at},1,108499,1,1", f"{at},1.5,108498,1,1"])
    csv_file(tmp_path / "in", "BIG", [f"{at},3000000000,1,1,1"])
    csv_file(tmp_path / "in", "CELLS", [f"{at},1.5,1.4,1", f"{at},1.5,1.4,1,1,9"])
    csv_file(tmp_path / "in", "VOL", [f"{at},1.5,1.4,much,1"])
    none = spark.createDataFrame([], "symbol string, decimal_factor int")
    run_once = lambda: {r["symbol"]: (r["status"], r["rows_in"], r["rows_out"], r["error"]) for r in migrate.migrate(spark, str(tmp_path / "in"), str(tmp_path / "out"), "tick", none).collect()}
    got = run_once()
    assert got["GOOD"] == ("ok", 1, 1, None) and got["RAW"] == ("ok", 2, 2, None) and got["MIX"] == ("ok", 2, 2, None)
    assert got["WORD"] == ("error", 3, 0, "2 rows cannot be taken, the first: ask: n/a")
    assert got["FAR"] == ("error", 1, 0, "beyond 32 bits: ask") == got["BIG"]
    assert got["CELLS"][:3] == ("error", 2, 0) and got["CELLS"][3].startswith("2 rows cannot be taken, the first: cells: ")
    assert got["VOL"] == ("error", 1, 0, "1 rows cannot be taken, the first: ask_vol: much")
    lake = lambda: sorted((r["symbol"], r["ask"], r["bid"], r["bid_vol"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = [("GOOD", 108501, 108499, None), ("MIX", 100000, 108499, 1.0), ("MIX", 150000, 108498, 1.0), ("RAW", 108501, 108499, 1.0), ("RAW", 108502, 108498, 1.0)]
    assert lake() == want
    assert run_once() == got and lake() == want  # running again replaces what it wrote
    csv_file(tmp_path / "in", "GOOD", [f"{at},1.1,1.0,1,1"])
    csv_file(tmp_path / "in", "GOOD", [f"{at},1.2,1.0,1,1"], "b")
    run_once()
    assert [r for r in lake() if r[0] == "GOOD"] == [("GOOD", 110000, 100000, 1.0), ("GOOD", 120000, 100000, 1.0)]


def test_only_unsorted_files_are_sorted(spark, tmp_path):
    at = "2024-01-01 00:00:0{}+00:00,{}.5,1.5,1,1"
    csv_file(tmp_path / "in", "UP", [at.format(i // 2, i) for i in range(9)])
    csv_file(tmp_path / "in", "DOWN", [at.format(9 - i // 2, i) for i in range(9)])
    one = spark.createDataFrame([], "symbol string, decimal_factor int")
    got = migrate.migrate(spark, str(tmp_path / "in"), str(tmp_path / "out"), "tick", one, factor=2)
    assert {r["symbol"]: r["resorted"] for r in got.collect()} == {"UP": False, "DOWN": True}
    table = spark.read.parquet(str(tmp_path / "out"))
    for symbol, places in {"UP": list(range(9)), "DOWN": [8, 6, 7, 4, 5, 2, 3, 0, 1]}.items():
        rows = table.where(F.col("symbol") == symbol).select("ask", "timestamp", "_metadata.file_path", "_metadata.row_index").orderBy("timestamp", "file_path", "row_index").collect()
        assert [(r["ask"] - 1) // 2 for r in rows] == places
    assert {r["inversions"] for r in quality.file_order(table).collect()} == {0}
    runs = spark.createDataFrame([("f", 0, 0, 1), ("f", 0, 1, 5), ("f", 7, 0, 4), ("g", 0, 0, 3), ("g", 9, 0, 3), ("g", 10, 0, 8)], "file string, block long, row long, timestamp long")
    for parts in (1, 3, 6):
        assert dict(quality.sorted_files(runs.orderBy("file", "block", "row").coalesce(1).repartitionByRange(parts, "file", "block", "row").sortWithinPartitions("file", "block", "row")).collect()) == {"f": False, "g": True}


def test_log_and_lists(spark):
    lines = [("f", 1, "2024-01-01 00:00:00 | A | tick | 2024-01-01 | first | part"), ("f", 2, "more"), ("f", 3, "2024-01-02 00:00:00 | B | h1 | 2024-01-01 | x")]
    got = files.parse_failures(spark.createDataFrame(lines, "file string, line_no int, value string")).orderBy("ts").collect()
    assert [r["message"] for r in got] == ["first | part\nmore", "x"]
    assert files.failure_lines(spark.createDataFrame([got[1]])).first()[0] == lines[2][2]
    ok = spark.createDataFrame([('{"tickers": ["eurusd", "EURUSD", "x"]}',)], "value string")
    assert sorted(r[0] for r in files.parse_ticker_list(ok).collect()) == ["EURUSD", "X"]
    with pytest.raises(Exception, match="must be a list"):
        files.parse_ticker_list(spark.createDataFrame([('{"tickers": 3}',)], "value string")).collect()
    good, bad = files.parse_instruments(spark.createDataFrame([('{"eurusd": {"decimalFactor": 10, "startHourForTicks": "2003-05-05T00:00:00Z"}, "none": {"name": "n"}}',)], "value string"))
    assert good.first()["start_dates"] == {"tick": day("2003-05-05")} and bad.first()["symbol"] == "NONE"


def test_quality_and_metadata(spark, tmp_path):
    b = bars(spark, [("A", 900_000, 5, 4, 6, 5, -1.0), ("A", 900_001, 5, 6, 4, 5, 1.0)])
    got = {(r["rule"], r["n"], r["example"]) for r in quality.validate(b, "m15", 900_000, (1, 10)).collect()}
    assert got == {("high under low", 1, 900_000), ("volume negative", 1, 900_000), ("misaligned", 1, 900_001)}
    assert quality.schema_faults(b.withColumn("open", F.lit("x")).drop("low"), "m15") == [("missing column", "low"), ("wrong type", "open")]
    path = str(tmp_path / "meta")
    files.append_parquet(files.with_metadata(b, decimal_factor=100), path, ("symbol",))
    assert spark.read.parquet(path).schema["timestamp"].metadata["decimal_factor"] == 100


def test_lakes_of_several_schemas_and_facts(spark, tmp_path):
    t = spark.createDataFrame([("A", 1, 2, 1, 1.0, 1.0)], "symbol string, timestamp long, ask int, bid int, ask_vol float, bid_vol float")
    path = str(tmp_path / "mixed")
    assert files.tolerant_scan(spark, str(tmp_path), "tick").count() == 0
    files.append_parquet(files.with_metadata(t, decimal_factor=10), path, ("symbol",))
    files.append_parquet(files.with_metadata(t.withColumn("ask", F.lit(7).cast("long")).withColumn("more", F.lit("x")), decimal_factor=10, source="b"), path, ("symbol",))
    got = files.tolerant_scan(spark, path, "tick")
    assert sorted(r["ask"] for r in got.collect()) == [2, 7] and set(got.columns) == {"symbol", *schemas.TICK.fieldNames()}
    assert dict(files.lake_facts(files.footers(spark, path)).collect()) == {"decimal_factor": "10", "source": "b"}
    files.append_parquet(files.with_metadata(t, decimal_factor=100), path, ("symbol",))
    with pytest.raises(Exception, match="differ in decimal_factor"):
        files.lake_facts(files.footers(spark, path)).collect()
    files.append_parquet(t.withColumn("bid", F.lit(1 << 40)), f"{path}2", ("symbol",))
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        files.tolerant_scan(spark, f"{path}2", "tick").collect()
    files.append_parquet(t.drop("bid"), f"{path}3", ("symbol",))
    with pytest.raises(ValueError, match="lack bid"):
        files.tolerant_scan(spark, f"{path}3", "tick")
    (tmp_path / "mixed3" / "junk.parquet").write_bytes(b"no parquet")
    assert sorted(r["schema"] is None for r in files.footers(spark, f"{path}3").collect()) == [False, True]
    with pytest.raises(ValueError, match="decimal_factor"):
        compact.shared_facts(files.with_metadata(t, decimal_factor=1), files.with_metadata(t, decimal_factor=2))


def test_quotes_that_come_late_or_twice(spark, tmp_path):
    schema = "ticker string, price double, previous_close double, ts long, seq long"
    path, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    days = [[("A", 2.0, 1.0, 20, 1), ("B", None, 1.0, 99, 2)], [("A", 1.0, 1.0, 10, 3), ("C", 5.0, 0.0, 5, 4)], [("A", 3.0, 2.0, 20, 5)], [("C", float("nan"), 1.0, 90, 6)]]
    want = {}
    for i, rows in enumerate(days):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        got = {r["ticker"]: (r["price"], r["ts"], r["n"]) for r in jobs.run_quotes(spark, path, spark.createDataFrame([], schema).schema, out, state, fold=2).collect()}
        want = [{"A": (2.0, 20, 1)}, {"A": (2.0, 20, 2), "C": (5.0, 5, 1)}, {"A": (3.0, 20, 3), "C": (5.0, 5, 1)}, {"A": (3.0, 20, 3), "C": (5.0, 5, 1)}][i]
        assert got == want
    changed = spark.read.parquet(f"{out}/changes")
    assert changed.where("ticker = 'C'").count() == 1  # a batch writes what it changed, no whole snapshot
    assert jobs.run_quotes(spark, path, spark.createDataFrame([], schema).schema, out, state).count() == 2


def test_growth(spark):
    s = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 0.0), ("B", 2, 2.0)], "k string, dt int, cost double")
    got = {r["k"]: (r["ratio"], r["grows"]) for r in score.growth_ratio(s, ["k"]).collect()}
    assert got == {"A": (2.0, True), "B": (None, None)}
