import pytest
from compare import database, same

from loam.jobs import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(name, spark, sf_dir, con):
    same(catalogue.QUERIES[name](spark, sf_dir), con, catalogue.ORACLES[name])


def test_json_lines_read_back(spark, sf_dir):
    import json

    got = [json.loads(r[0]) for r in catalogue.result_json(spark, sf_dir).collect()]
    assert [g["rank"] for g in sorted(got, key=lambda g: g["rank"])] == list(range(1, 21))
    assert {"score", "rel_path", "tags", "chunk_id"} <= set(got[0])


def test_markdown_chunks_cover_every_document(spark, sf_dir):
    got = catalogue.markdown_chunks(spark, sf_dir).toPandas()
    assert got["rel_path"].nunique() == 200
    assert got["size"].max() <= 4000
    assert (got.groupby("rel_path")["chunk_index"].max() + 1 == got.groupby("rel_path").size()).all()
