"""Cases that the third round of findings named."""

import datetime as dt
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tidelake import catalog
from tidelake.llm import language
from tidelake.operators import migrate, quality
from tidelake.plans import ingest
from tidelake.sources import files


def test_violations_are_those_of_the_sql(spark, tmp_path):
    at = dt.datetime(2024, 1, 5, 1, 2, 3)
    rows = [(0, at, 1, "view", 0.0), (1, at.replace(microsecond=7000), 2, "view", 500.0), (2, at.replace(year=2023), 3, "view", 2.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        duck.sql(f"CREATE VIEW {name} AS SELECT 0::BIGINT AS s_suppkey, 'A' AS s_name")
    want = sorted(duck.execute(catalog.ORACLE_SQL["quality_violations"]).fetchall())
    assert sorted(tuple(r) for r in catalog.QUERIES["quality_violations"](spark, str(tmp_path)).collect()) == want
    assert ("S1", "bid out of range", 1, 1704416523000) in want and len(want) == 5


def test_a_catalogue_of_one_file_is_planned_by_many_tasks(spark):
    day = lambda text: F.lit(text).cast("date")
    catalogue = spark.range(0, 200, 1, 1).select(F.format_string("A%03d", "id").alias("symbol"), F.lit(1).alias("decimal_factor"), F.create_map(*(x for k in ("tick", "m1", "h1") for x in (F.lit(k), day("2024-01-01")))).alias("start_dates"))
    none = spark.createDataFrame([], "symbol string, timeframe string, last_date date")
    plan = ingest.build_plan(catalogue, ["tick", "m1", "m15", "h1", "h4"], none, day("2024-01-03"))
    rows = plan.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 4 and max(r["count"] for r in rows) < 200 * (3 * 3 + 2) / 2
    keys = ingest.chunk_keys(plan)
    assert keys.count() == keys.select("key").distinct().count() == 200 * (3 * 24 + 3 + 1)


def test_a_migration_writes_a_file_a_source_without_steps_of_the_driver(spark, tmp_path):
    at = "2024-01-01 00:00:0{}+00:00,{}.5,1.5,1,"
    symbols = ["EUR=X", "A'B", *(f"S{i}" for i in range(20))]
    for i, symbol in enumerate(symbols):
        for name in ("up", "down"):
            folder = tmp_path / "in" / symbol / "tick"
            folder.mkdir(parents=True, exist_ok=True)
            lines = [at.format(k, i) for k in range(5)]
            (folder / f"{name}.csv").write_text("\n".join(["timestamp,ask,bid,ask_vol,bid_vol", *(lines if name == "up" else lines[::-1])]) + "\n")
    none, out = spark.createDataFrame([], "symbol string, decimal_factor int"), tmp_path / "out"
    run_once = lambda: migrate.migrate(spark, str(tmp_path / "in"), str(out), "tick", none, factor=2).groupBy("status").count().collect()
    lake = lambda: sorted((r["symbol"], r["n"], r["low"], r["high"]) for r in spark.read.parquet(str(out)).groupBy("symbol").agg(F.count("*").alias("n"), F.min("ask").alias("low"), F.max("ask").alias("high")).collect())
    want = sorted((s, 10, 2 * i + 1, 2 * i + 1) for i, s in enumerate(symbols))
    assert [tuple(r) for r in run_once()] == [("ok", 44)] and lake() == want
    first = sorted(out.rglob("*.parquet"))
    (tmp_path / "in" / "S3" / "tick" / "up.csv").write_text("timestamp,ask,bid,ask_vol,bid_vol\nsoon,1,1,1,1\n")
    assert {tuple(r) for r in run_once()} == {("ok", 43), ("error", 1)} and lake() == want  # what fails now stays as it was
    again = sorted(p for p in out.rglob("*") if p.is_file())
    assert len(first) == 44 and len(set(first) & set(again)) == 1 and len(again) == 44  # no checksums or staged files beside them
    assert {r["inversions"] for r in quality.file_order(spark.read.parquet(str(out))).collect()} == {0}
    facts = {"decimal_factor": 2, "timeframe": "tick", "source": "migration"}
    assert spark.read.parquet(str(out)).schema["timestamp"].metadata == facts
    told = files.lake_facts(files.footers(spark, str(out / "symbol=S1"))).collect()
    assert {r["name"]: r["value"] for r in told} == {k: str(v) for k, v in facts.items()}


def test_publishing_twice_changes_nothing(tmp_path):
    for name, text in {"new": "2", "out/symbol=A/source=s/part-old.parquet": "1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    batch = pa.RecordBatch.from_pylist([{"symbol": "A", "source": "s", "files": [{"name": "part-new.parquet", "path": str(tmp_path / "new")}]}])
    for _ in range(2):
        list(migrate._publish(str(tmp_path / "out"))(iter([batch])))
        assert [(p.name, p.read_text()) for p in (tmp_path / "out").rglob("*") if p.is_file()] == [("part-new.parquet", "2")]


def test_languages_are_learned_from_every_row(spark):
    rows = [(i, f"{'kala' if i % 3 else 'mina'} w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " + "z" * 20, "aa") for i in range(1500)] + [(i, "Grost, blent? grost!", "bb") for i in range(1500, 1510)] + [(9999, None, "cc"), (9998, "12", "cc"), (9997, "grost", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = Counter(w for _, t, _ in rows[:1500] for w in t.replace("z" * 20, "z" * 16 + " zzzz").split())
    ranked = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    assert language.fit(docs) == {"aa": " ".join(reversed(ranked)).encode(), "bb": b"blent grost"}
    assert language.fit(docs, dict_bytes=16) == {"aa": b"zzzz", "bb": b"blent grost"}


def test_the_least_margin_comes_from_every_row_that_is_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100_000)).where("lang = 'en' OR lang = 'de'")
    dicts, least = language.learn(docs, share=0.1)
    rest = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(4)) == 0)
    margins = sorted(r["margin"] for r in language.classify(rest, dicts).where("lang = lang_pred AND margin > 0").collect())
    want = margins[int(0.1 * len(margins))]
    assert len(margins) > 300 and want - 1 / language.STEPS <= 2 * least <= want
