"""Commit-last tables, chunk files and the ledger, message indexes from files."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from perimeter.operators import weather as W
from perimeter.sources import catalog, ledger, messages, tables
from perimeter.sources import detections as S


def rows_of(df):
    return sorted((r["fire_id"], r["row"], r["v"]) for r in df.collect())


@pytest.fixture
def cells(spark):
    return spark.createDataFrame([(f"f{i % 6}", i, float(i)) for i in range(600)], "fire_id string, row int, v double")


def test_a_build_that_dies_is_built_again(spark, cells, tmp_path):
    root = f"{tmp_path}/t"
    assert tables.built(spark, root, "fire_id") is None
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, root, "fire_id")
    first = cells.filter("fire_id < 'f2'")
    assert rows_of(tables.build_missing(first, root, "fire_id", ["row"])) == rows_of(first)
    # Dies while rows are written: some tasks have finished, one fails.
    dying = cells.withColumn("v", F.when(F.col("row") == 599, F.raise_error(F.lit("lost")).cast("double")).otherwise(-F.col("v")))
    with pytest.raises(PySparkException):
        tables.build_missing(dying, root, "fire_id", ["row"])
    # Dies after its rows and keys, before its manifest row.
    tables.write_build(cells.withColumn("v", F.lit(-1.0)), root, "fire_id")
    assert len(os.listdir(f"{root}/data")) >= 2
    assert rows_of(tables.read_table(spark, root, "fire_id")) == rows_of(first)
    assert sorted(r[0] for r in tables.built(spark, root, "fire_id").collect()) == ["f0", "f1"]
    assert rows_of(tables.build_missing(cells, root, "fire_id", ["row"])) == rows_of(cells)


def test_overwrite_replaces_keys_and_keeps_others(spark, cells, tmp_path):
    root = f"{tmp_path}/t"
    tables.build_missing(cells, root, "fire_id")
    again = cells.filter("fire_id = 'f3' and row < 100").withColumn("v", F.col("v") + 0.5)
    want = rows_of(cells.filter("fire_id <> 'f3'").unionByName(again))
    assert rows_of(tables.build_missing(again, root, "fire_id", overwrite=True)) == want
    # Nothing is missing, so nothing changes.
    assert rows_of(tables.build_missing(cells, root, "fire_id")) == want
    assert [r["n_keys"] for r in tables.manifest(spark, root).orderBy("version").collect()] == [6, 1, 0]


def test_a_key_of_most_rows_is_written_by_several_tasks(spark, tmp_path):
    hot = spark.range(200_000).select(F.lit("f0").alias("fire_id"), F.col("id").cast("int").alias("row"), F.rand(1).alias("v"))
    build = tables.write_build(hot, f"{tmp_path}/t", "fire_id", ["row"])
    assert sum(f.startswith("part-") for f in os.listdir(f"{tmp_path}/t/data/{build}")) > 1


def test_ledger_lists_files_without_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, 'x,"y"'), ("a", 2.5, None), ("c", 3.0, "z")], "chunk string, latitude double, longitude string")
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk string")
    ledger.land_chunks(chunks, rows, f"{tmp_path}/landed", ["latitude", "longitude"])
    os.makedirs(f"{tmp_path}/landed/chunk=d")
    open(f"{tmp_path}/landed/chunk=d/part-0.txt", "w").close()
    # A file of no bytes is a write that died before its header: it has not landed.
    got = {r["chunk"]: (r["n_lines"], r["bytes"] > 0) for r in ledger.file_ledger(spark, f"{tmp_path}/landed").collect()}
    assert got == {"a": (3, True), "b": (1, True), "c": (2, True)}
    empty = S.empty_files(ledger.file_ledger(spark, f"{tmp_path}/landed"))
    assert sorted(r["chunk"] for r in empty.collect()) == ["b"]
    planned = spark.createDataFrame([("b",), ("d",)], "chunk string")
    assert [r["chunk"] for r in S.pending_chunks(planned, ledger.file_ledger(spark, f"{tmp_path}/landed"), "chunk").collect()] == ["d"]


def test_message_index_of_files(spark, tmp_path):
    lines = {"h1.idx": ["1:0:d=1:UGRD:10 m above ground:anl:", "2:100:d=1:VGRD:10 m above ground:anl:", "", "bad", "3:x:d=1:TMP:2 m above ground:anl:",
                        "4:250:d=1:TMP:2 m above ground:anl:", "5:300:d=1:DPT:2 m above ground:anl:"],
             "h2.idx": ["1:0:d=1:UGRD:10 m above ground:anl:"], "h3.idx": []}
    for name, of in lines.items():
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write("\n".join(of))
    index = messages.read_message_index(spark, f"{tmp_path}/*.idx")
    got = sorted((r["file"].rsplit("/", 1)[1], r["msg"], r["start"], r["end"]) for r in index.collect())
    assert got == [("h1.idx", 1, 0, 99), ("h1.idx", 2, 100, 249), ("h1.idx", 4, 250, 299), ("h1.idx", 5, 300, -1), ("h2.idx", 1, 0, -1)]
    chosen = messages.select_messages(index)
    assert {r["file"].rsplit("/", 1)[1] for r in chosen.collect()} == {"h1.idx"} and chosen.count() == 4
    assert [(r["first"], r["last"], r["messages"]) for r in messages.contiguous_runs(chosen).collect()] == [(0, -1, 4)]


def test_selecting_messages_reads_the_index_once(spark, tmp_path):
    with open(f"{tmp_path}/h1.idx", "w") as f:
        f.write("1:0:d=1:UGRD:10 m above ground:anl:")
    runs = messages.contiguous_runs(messages.select_messages(messages.read_message_index(spark, f"{tmp_path}/*.idx")))
    plan = runs._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_split_lists_are_read_back(spark, tmp_path):
    splits = spark.createDataFrame([(f"f{i}", ("train", "val", "test")[i % 3]) for i in range(30)], "fire_id string, split string")
    catalog.write_splits(splits, f"{tmp_path}/splits")
    assert sorted(map(tuple, catalog.read_splits(spark, f"{tmp_path}/splits").collect())) == sorted(map(tuple, splits.collect()))
    assert sorted(f for f in os.listdir(f"{tmp_path}/splits") if "=" in f) == ["split=test", "split=train", "split=val"]


def part_files(root):
    return {(b, f): os.path.getmtime(f"{root}/data/{b}/{f}") for b in os.listdir(f"{root}/data") for f in os.listdir(f"{root}/data/{b}") if f.endswith(".parquet")}


def test_a_merge_writes_only_the_parts_it_touches(spark, tmp_path):
    root = f"{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, "part string, id int, v double")
    first = [(f"p{i % 4}", i, 1.0) for i in range(40)]
    tables.merge_rows(make(first), root, "part", ["id"])
    before = part_files(root)
    fresh = [("p1", 1, 2.0), ("p1", 101, 2.0), ("p9", 109, 2.0)]
    got = tables.merge_rows(make(fresh), root, "part", ["id"])
    want = [r for r in first if r[1] != 1] + fresh
    assert sorted(map(tuple, got.select("part", "id", "v").collect())) == sorted(want)
    after = part_files(root)
    assert before.items() <= after.items()
    newest = tables.manifest(spark, root).orderBy(F.desc("version")).first()["build"]
    written = spark.read.parquet(f"{root}/data/{newest}")
    assert {r["part"] for r in written.select("part").distinct().collect()} == {"p1", "p9"} and written.count() == 12


def test_weather_store_and_windows_over_two_runs(spark, tmp_path):
    """The second run adds a fire and corrects an hour; no row of the first run's other hours moves, and no window does."""
    fields = "fire_id string, hour long, iy int, ix int, u10 double"
    run = lambda fires, u: spark.createDataFrame([(f, h, iy, 5, u) for f in fires for h in (0, 30, 60) for iy in (3, 40)], fields)
    store = W.upsert(run(["a", "b"], 1.0), f"{tmp_path}/store")
    held = store.filter("hour <> 60").collect()
    fresh = run(["c"], 3.0).unionByName(run(["a"], 9.0).filter("hour = 60"))
    got = W.upsert(fresh, f"{tmp_path}/store")
    rows = {(r["fire_id"], r["hour"], r["iy"]): r["u10"] for r in got.collect()}
    assert len(rows) == got.count() == 18
    assert {k: v for k, v in rows.items() if k[0] == "b" or k[0] == "a" and k[1] != 60} == {
        (f, h, iy): 1.0 for f in "ab" for h in (0, 30, 60) for iy in (3, 40) if f == "b" or h != 60}
    assert {v for k, v in rows.items() if k[0] == "a" and k[1] == 60} == {9.0} and {v for k, v in rows.items() if k[0] == "c"} == {3.0}
    assert {(r["fire_id"], r["hour"], r["iy"]) for r in held} <= set(rows)
    box = lambda rows: spark.createDataFrame(rows, "fire_id string, iy0 int, iy1 int, ix0 int, ix1 int")
    W.pin_windows(box([("a", 1, 5, 1, 5)]), f"{tmp_path}/pinned")
    again = W.pin_windows(box([("a", 0, 9, 0, 9), ("c", 2, 3, 2, 3)]), f"{tmp_path}/pinned")
    assert sorted(map(tuple, again.collect())) == [("a", 1, 5, 1, 5), ("c", 2, 3, 2, 3)]
