import json

import pytest
from pyspark.sql import functions as F

from utterline.__main__ import main
from utterline.plans import stages


def answer(asked):
    return asked.select("id", F.lit("```json\n{'intent': 'buy', 'wrap_up': True,}\n```").alias("answer"))


def test_a_run_and_a_second_one(spark, tmp_path, capsys):
    rows = [("r1", "d1", 1, "Good morning and um welcome", "SALES"), ("r2", "d1", 2, "um yes", "CLIENT"), ("r3", "d2", 1, " ", "SALES"), ("r4", "d2", 2, "hello", None)]
    spark.createDataFrame(rows, "id string, dialog_id string, row_num int, row_text string, speaker_id string").write.parquet(f"{tmp_path}/rows")
    (tmp_path / "c.json").write_text(json.dumps({"words": {"parasites": ["um"], "slang": ["yo"]}, "fuzzy": {"greeting": ["good morning"]}, "off": ["slang"], "enums": {"intent": ["buy"]}}))
    for _ in range(2):
        assert main(["run-all", "--folder", str(tmp_path), "--config", str(tmp_path / "c.json"), "--provider", f"{__name__}:answer"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"rows": 4, "criteria": 3, "answers": 2, "coverage": 75.0}
    got = {r.dialog_id: r for r in spark.read.parquet(f"{tmp_path}/summary").collect()}
    assert (got["d1"].parasites_sales, got["d1"].greeting_sales, got["d1"].rows_count, got["d1"].llm_intent, got["d1"].llm_wrap_up) == ("um", "good morning", 2, "buy", 1)
    assert got["d2"].parasites_sales == "" and "slang_sales" not in got["d1"].asDict()


def test_unknown_settings_are_told(tmp_path):
    (tmp_path / "c.json").write_text('{"wrods": {}}')
    with pytest.raises(ValueError, match="wrods"):
        stages.validate(str(tmp_path / "c.json"))
