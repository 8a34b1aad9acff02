import compare
import pytest

from utterline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    more, less, n = compare.difference(QUERIES[name](spark, SF), compare.connect(SF), ORACLES[name])
    assert not more and not less and n


def test_neighbours_are_the_same_numbers(spark):
    """Products are summed in one order here and in the SQL, so they agree to the last bit."""
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in QUERIES["op1_hilbert_neighbours"](spark, SF).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == set(compare.connect(SF).execute(ORACLES["op1_hilbert_neighbours"]).fetchall())
