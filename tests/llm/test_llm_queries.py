import pytest

from compare import canon, connect
from corvane.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_gives_what_its_sql_gives(spark, data, name):
    got = queries.queries()[name](spark, data).toPandas()
    assert not got.astype(str).duplicated().any()
    if name in oracle.sql():
        assert canon(got) == canon(connect(data).execute(oracle.sql()[name]).df())


def _folder(spark, path, url, mail, text):
    spark.createDataFrame([(1, url, mail), (2, None, None)], "id long, source_url string, author_email string").write.parquet(f"{path}/artifact.parquet")
    spark.createDataFrame([(1, text), (2, None)], "id long, text string").write.parquet(f"{path}/chunk.parquet")
    return str(path)


def test_credentials_are_masked_at_both_places(spark, tmp_path):
    d = _folder(spark, tmp_path, "https://ci:Xk29fLq7Zw@h.example/r/blob/a/b.py?x=1", None, 'password = "Xk29fLq7Zw!"\n')
    want = {("chunk.text", 1, 'password = "[REDACTED]"\n'), ("artifact.source_url", 1, "https://ci:[REDACTED]@h.example/r/blob/a/b.py?x=1")}
    assert {(r.place, r.row_id, r.masked) for r in queries.p5_masked(spark, d).collect()} == want


def test_personal_data_is_masked_at_both_places(spark, tmp_path):
    d = _folder(spark, tmp_path, None, "mara.lind@mail.example", "ask mara.lind@mail.example\n")
    want = {("chunk.text", 1, "ask [EMAIL]\n"), ("artifact.author_email", 1, "[EMAIL]")}
    assert {(r.place, r.row_id, r.masked) for r in queries.p7_masked(spark, d).collect()} == want
