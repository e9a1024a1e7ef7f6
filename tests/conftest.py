import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from flightpulse.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, memory="4g", app="flightpulse-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def flights(spark, sf_dir):
    from flightpulse.sources.lineitem import flights_from_lineitem

    return flights_from_lineitem(spark, sf_dir)


FLIGHT_SCHEMA = (
    "carrier string, origin string, dest string, status string, sched_dep timestamp_ntz, "
    "actual_dep timestamp_ntz, sched_arr timestamp_ntz, actual_arr timestamp_ntz, ref_month string"
)


@pytest.fixture(scope="session")
def make_flights(spark):
    """Flights from short dictionaries; unnamed fields are null."""
    from datetime import datetime

    names = [part.split()[0] for part in FLIGHT_SCHEMA.split(", ")]

    def make(rows):
        def value(row, name):
            found = row.get(name)
            if isinstance(found, str) and name.endswith(("_dep", "_arr")):
                return datetime.fromisoformat(found)
            return found

        data = [tuple(value({"ref_month": "2024-01", **row}, name) for name in names) for row in rows]
        return spark.createDataFrame(data, FLIGHT_SCHEMA)

    return make
