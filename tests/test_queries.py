"""Every query of the library beside its SQL."""

import pytest
from compare import difference

from quillspark import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    assert difference(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF) is None


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_colors_beyond_32_bits(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"p_partkey": pa.array([0, 255, 2118, 2119, 19_999, 1_200_000, 2**40, None], pa.int64())}), tmp_path / "part.parquet")
    assert difference(spark, catalog.queries()["color_pack_unpack"], catalog.oracle_sql()["color_pack_unpack"], str(tmp_path)) is None
