import pytest

from weftgraph import session


def test_shared_folder_and_written_tables(spark):
    df = session.written(spark.range(5))
    assert df.count() == 5 and df._weftgraph_path.startswith(session.shared_dir(spark))
    session.discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._weftgraph_path).count()


def test_package_is_shipped_once(spark):
    session.ship(spark)
    session.ship(spark)
    out = spark.range(1).mapInPandas(lambda it: (b.assign(id=len(__import__("weftgraph").__version__)) for b in it), "id long")
    assert out.first().id > 0
