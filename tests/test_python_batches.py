import pytest

from corpusloom.operators.catalog import QUERIES


@pytest.mark.parametrize("name", ["fn_29", "src_13", "html_05", "chk_03", "ret_01", "ret_11", "ret_12"])
def test_python_sees_small_batches(spark, name):
    """Texts of a batch are bounded in bytes, whatever ran in the session before."""
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("8m", str(8 << 20), f"{8 << 20}b")
