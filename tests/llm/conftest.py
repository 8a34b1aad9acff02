import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    passage = "the quick brown fox jumps over the lazy dog while seven silent owls watch from an old wooden bridge near the river bank tonight"
    long = " ".join(f"word{i % 977} and{i}" for i in range(9000))
    rows = [(1, passage), (2, passage), (3, "Intro. " + passage + " tail"), (4, None), (5, ""), (6, "a" * 1500), (7, long), (8, "one two"), (8, "one two"), (9, "Ünïcode straße <|endoftext|> 漢字 don't  \n x"), (None, passage), (10, " \n\t "), (11, passage + " " + passage)]
    return spark.createDataFrame([(i, t, "en", 1.0, f"id{k}", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, score double, _id string, rank int").repartition(3)
