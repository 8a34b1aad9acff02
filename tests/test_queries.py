import compare
import duckdb
import pytest

from utterline.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        more, less, n = compare.difference(df, compare.connect(SF), ORACLES[name])
        assert not more and not less and n
    else:
        assert df.count()


def test_lexicon_words_are_in_its_order(spark, tmp_path):
    texts = [(0, "Los que das; de"), (1, "with the and"), (2, "under"), (3, ""), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare.difference(QUERIES["exact_lexicon"](spark, str(tmp_path)), con, ORACLES["exact_lexicon"]) == ([], [], 4)
