import json

import pytest
from pyspark.sql import functions as F

from utterline.sources import state, tables


def test_state_is_merged_and_saved(spark, tmp_path):
    path = str(tmp_path / "state.json")
    assert state.load_state(path, {"a": 1}) == {"a": 1}
    (tmp_path / "state.json").write_text("{broken")
    assert state.load_state(path)["user_stats"] == {}
    s = state.load_state(path)
    for user, name in ((1, "ann"), (2, None), (1, None)):
        state.count_use(s, user, name, now=5.0)
    state.save_state(s | {"extra": 1}, path)
    again = state.load_state(path)
    assert again["extra"] == 1 and again["total_unique_users"] == 2 and again["messages_processed"] == 0
    assert [tuple(r) for r in state.users(spark, again).collect()] == [("1", "ann", 2, 5.0), ("2", "user_2", 1, 5.0)]
    assert state.size_mb(3 << 20) == 3.0 and state.uptime_hours({"start_time": 0}, 7200) == 2.0


def test_errors_are_added(tmp_path):
    path = str(tmp_path / "logs" / "errors.json")
    assert state.append_errors([{"file": "a"}], path) == 1 and state.append_errors([{"file": "b"}, {"file": "c"}], path) == 3
    assert [e["file"] for e in json.loads((tmp_path / "logs" / "errors.json").read_text())] == ["a", "b", "c"]


def test_settings_are_found(tmp_path):
    (tmp_path / "deep" / "config").mkdir(parents=True)
    (tmp_path / "deep" / "config" / "x.json").write_text('{"a": {"b": [1, 2]}, "c": 3}')
    s = state.Settings("../config/x.json", [str(tmp_path)])
    assert s.get("a.b") == [1, 2] and s.get("a.z", 7) == 7 and s.get("c.d") is None and s.lists("a") == {"b": [1, 2]}
    for key, error in (("zz", KeyError), ("c", ValueError)):
        with pytest.raises(error):
            s.lists(key)
    with pytest.raises(FileNotFoundError):
        state.Settings("none.json", [str(tmp_path)])


def test_datasets_go_out_and_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "quoted"\nline, with comma', ["x", "y"], "x, y")], "dialog_id string, text string, topics array<string>, topics_csv string")
    state.export_dataset(rows, f"{tmp_path}/csv", f"{tmp_path}/jsonl")
    assert [tuple(r) for r in state.read_dataset(spark, f"{tmp_path}/csv").collect()] == [("1", 'a "quoted"\nline, with comma', ["x", "y"])]
    assert spark.read.json(f"{tmp_path}/jsonl").select("dialog_id", "text", "topics").first()[0:] == ("1", 'a "quoted"\nline, with comma', ["x", "y"])
    table = tables.csv_table(spark.createDataFrame([], "a int").sparkSession, _csv(tmp_path), "a int, b string")
    assert [tuple(r) for r in table.collect()] == [(1, "x")]
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.csv_table(spark, _csv(tmp_path), "a int, z string")


def _csv(folder):
    (folder / "t.csv").write_text("a,b\n1,x\n")
    return str(folder / "t.csv")


def test_files_and_folders(spark, tmp_path):
    for name in ("one/a.wav", "two/a.wav", "two/b.mp3", "c.wav"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    listing = tables.audio_files(spark, str(tmp_path))
    names = spark.createDataFrame([("a.wav",), ("b.mp3",), ("c.wav",), ("d.wav",)], "f string")
    got = {r.f: r.path for r in tables.found_in(names, "f", listing, [f"{tmp_path}/two", f"{tmp_path}/one"]).collect()}
    assert got["a.wav"].endswith("two/a.wav") and got["b.mp3"].endswith("two/b.mp3") and got["c.wav"] is None and got["d.wav"] is None
    assert tables.audio_files(spark, str(tmp_path), most=2).count() == 2


def test_lookups_and_order(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "a", 0)], "id int, v string, n int")
    assert tables.find_by(df, "id", 2).first().v == "b" and tables.find_by(df, "id", 9).count() == 0
    assert tables.exists(df, "v", "b") and not tables.exists(df, "v", "z")
    assert [r.id for r in tables.ordered(df, "v", "n", "missing").collect()] == [3, 1, 2] and [r.id for r in tables.find_all(df, "n").collect()] == [3, 2, 1]
    assert tables.resolved(df.toDF("id", "v.1", "n"), ["v", "n"]).columns == ["id", "v", "n"]
    assert {r.id: r.ordinal for r in tables.numbered(df, "v", "n").collect()} == {3: 1, 1: 2, 2: 3}


def test_appended_and_published(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    for _ in range(2):
        tables.appended(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    with pytest.raises(TypeError):
        tables.appended(df.withColumn("id", F.lit("x")), f"{tmp_path}/t")
    for n in (1, 2):
        tables.published(spark.range(n), f"{tmp_path}/p")
        assert tables.current(spark, f"{tmp_path}/p").count() == n


def test_databases_are_read_in_parts(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(10).selectExpr("CAST(id AS INT) AS id", "CAST(id * id AS INT) AS sq").write.format("jdbc").option("url", url).option("dbtable", "t").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    df = tables.jdbc_table(spark, url, "t", ("ID", 0, 10, 3), driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert df.rdd.getNumPartitions() == 3 and df.count() == 10
