import duckdb
import pytest
from compare import difference
from pyspark.sql import functions as F

from utterline.functions import text
from utterline.plans import ORACLES, QUERIES
from utterline.plans.stages import read_if_there
from utterline.streaming import files


def test_rows_are_detected_once(spark, tmp_path):
    rows, out = f"{tmp_path}/rows", f"{tmp_path}/out"
    found = {"hit": text.has_word(F.lower("t"), "um")}
    for new in ([(1, "um"), (2, "no"), (3, None)], [(2, "no"), (4, "Um so")]):
        spark.createDataFrame(new, "id int, t string").write.mode("append").parquet(rows)
        stream = files.arriving(spark, rows, "id int, t string")
        files.detect_new(stream, lambda: read_if_there(spark, str(tmp_path), "out"), "id", "t", found, out, f"{tmp_path}/state")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, True), (2, False), (4, True)]


@pytest.mark.parametrize("kind", ["file", "folder", "parts"])
def test_stream_reads_a_table_however_it_lies(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, 1, "user", "The end"), (1, 2, "system", "other"), (2, 1, "user", None), (3, 1, "user", "in the"), (4, 1, "user", "")], "conv_id long, turn long, role string, text string")
    own = f"{tmp_path}/conversations.parquet"
    if kind == "file":
        rows.toPandas().to_parquet(own)
    else:
        (rows.repartition(3, "conv_id").write.partitionBy("role") if kind == "parts" else rows.repartition(3, "conv_id").write).parquet(own)
    rows.toPandas().to_parquet(f"{tmp_path}/conversations.parquet2")
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM " + (f"'{own}'" if kind == "file" else f"read_parquet('{own}/**/*.parquet', hive_partitioning = true)"))
    assert difference(QUERIES["stream_detect"](spark, str(tmp_path)), con, ORACLES["stream_detect"]) == ([], [], 2)
