import os

import pytest
from oracle import duck, same

from glimpse.plans import answers, catalog, files, indexed, understanding

assert answers and files and indexed and understanding
DIR = os.environ.get("GLIMPSE_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert same(catalog.QUERIES[name](spark, DIR).toPandas(), con.execute(catalog.ORACLES[name]).fetchdf()) == ""


def test_spoken_intent_of_the_log(spark):
    """No SQL, as word bounds differ between engines: what the query adds to each text is found in each row, in its order."""
    rows = catalog.QUERIES["asr_intent"](spark, DIR).collect()
    assert rows and all(list(r.spoken)[:2] != [] and "Chào Bạn Nhé" in " ".join(r.spoken) and any(x.startswith("Hà Nam") for x in r.spoken) for r in rows)


def test_all_queries_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"asr_intent", "ann_search"}
