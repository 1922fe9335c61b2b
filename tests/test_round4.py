"""Cases that the fourth round of findings named."""

from pathlib import Path

from pyspark.sql import functions as F

from tidelake import workspace
from tidelake.llm import common, components, line_dedup, near_dedup
from tidelake.operators import quality
from tidelake.sources import files

LINE = "a long line number {} about the harbour and the prices of grain at the market in spring"


def folders(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return {str(p.relative_to(shared)) for p in shared.rglob("*") if p.name.startswith(("stored-", "rdd-"))}


def test_operators_leave_only_their_last_result_on_disk(spark):
    docs = spark.createDataFrame([(i, "\n".join([LINE.format(i % 7), f"own {i}"])) for i in range(60)], "doc_id long, text string")
    for operator in (line_dedup.dedup_lines, near_dedup.clusters):
        before = folders(spark)
        out = operator(docs)
        assert len(folders(spark) - before) == 1
        assert out.count() == len(out.collect()) == 60  # any number of actions
        assert spark.conf.get(common.FREES) == "false"


def test_shuffle_files_go_with_their_query(spark):
    """Inside the block no shuffle of an ended query is left to Spark's block managers; outside they are as before."""
    seen, stored = [], common.stored

    def shuffled():
        return spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 10).count()

    left = lambda: sum(1 for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for _ in Path(d).rglob("shuffle_*.data"))
    with common.passing(spark):
        start = left()
        for _ in range(5):
            stored(shuffled())
            shuffled().agg(F.sum("count")).first()
            seen.append(left() - start)
    assert max(seen) <= 4  # they go in the background; without it 5 times 2 to 4 each


def test_a_bucket_is_compared_in_one_place_until_it_is_large(spark, monkeypatch):
    """No row for each two blocks of a bucket of some thousand members; larger ones give the same pairs."""
    hint = F.struct((50 + F.col("id") % 7).cast("int").alias("n"))
    members = spark.range(3_000).select(F.lit(1).alias("key"), "id", F.lit(3_000).alias("n"), F.col("id").alias("root"), hint.alias("hint"), (F.col("id") % 2).cast("int").alias("grade"))
    possible = lambda x, y: (x["n"] == y["n"]) & (F.lit(1) == 1)
    near = lambda pairs: sorted(tuple(r) for r in pairs.where("b - a = 7").collect())
    every, dealt = components._dealt, []
    monkeypatch.setattr(components, "_dealt", lambda *x: (dealt.append(1), every(*x))[1])
    once = near(components.open_pairs(members, possible))
    assert once == [(i, i + 7) for i in range(2_993)] and not dealt
    monkeypatch.setattr(components, "BLOCK", 100)
    even = members.withColumn("grade", F.lit(0))
    assert near(components.open_pairs(even, possible)) == once and dealt


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / "in" / f"S{i}" / "tick").mkdir(parents=True)
        (tmp_path / "in" / f"S{i}" / "tick" / "a.csv").write_text(f"timestamp,ask,bid,ask_vol,bid_vol\n2024-01-01 00:00:00+00:00,{i}.5,1.5,1,\n")
    sc = spark.sparkContext
    before = spark.conf.get(workspace.LISTERS)
    sc.setJobGroup("listing", "")
    try:
        rows = files.scan_csv_tree(spark, str(tmp_path / "in"), "tick")
    finally:
        sc._jsc.clearJobGroup()
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 16 < 60
    assert rows.count() == 60 and spark.conf.get(workspace.LISTERS) == before


def test_steps_back_tell_the_rows_of_each_file(spark, tmp_path):
    spark.createDataFrame([("A", t) for t in (1, 3, 2)] + [("B", t) for t in (1, 1)], "symbol string, timestamp long").repartition(1).write.partitionBy("symbol").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t")).select("symbol", "timestamp", F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"), F.col("_metadata.row_index").alias("row"))
    assert sorted((r["symbol"], r["rows"], r["back"]) for r in quality.steps_back(table, "symbol").collect()) == [("A", 3, 1), ("B", 2, 0)]
