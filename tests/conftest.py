import pytest

from tabloom.session import spark_session


@pytest.fixture(scope="session")
def spark():
    session = spark_session("tests", "local[*]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
