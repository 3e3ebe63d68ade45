import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["broadcast", "salted"])
def join_path(request, spark):
    """Both ways of attaching a table: size-checked broadcast, and hot-key slicing beyond the bound."""
    from lociary.operators.keyed import BROADCAST_BYTES_CONF, HOT_SAMPLE_CONF

    if request.param == "salted":
        spark.conf.set(BROADCAST_BYTES_CONF, "0")
        spark.conf.set(HOT_SAMPLE_CONF, "1.0")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset(BROADCAST_BYTES_CONF)
    spark.conf.unset(HOT_SAMPLE_CONF)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
