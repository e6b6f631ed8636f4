"""The queries must run in a session they did not start themselves."""

from pathlib import Path

import pytest

from noonwatt import session


def test_configure_sets_only_what_a_running_session_can_change(spark):
    for key in session.RUNTIME_SETTINGS:
        assert spark.conf.isModifiable(key), key
    before = spark.conf.get("spark.sql.session.timeZone")
    session.configure(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == before


def test_release_removes_written_tables(spark, tmp_path):
    from noonwatt.sources.tables import write_table

    kept = write_table(spark.range(3), spark, "part")
    folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists()
    session.release(spark)
    assert not folder.exists()


class Named:
    """Stands in for a session started with ``spark.checkpoint.dir``."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder}


def test_written_tables_go_below_the_shared_folder(tmp_path):
    cluster = Named(str(tmp_path))
    assert session.shared_folder(cluster).startswith(str(tmp_path))
    assert session.shared_folder(cluster) != session.shared_folder(cluster)


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York"])
def test_queries_do_not_depend_on_the_session_time_zone(spark, zone):
    import __spark_entry__ as entry

    before = spark.conf.get("spark.sql.session.timeZone")
    names = ("mart_solar_features", "src_price", "src_installed_power", "fn_parse_time", "backtest")
    run = lambda n: sorted(map(str, entry.queries()[n](spark, "/root/testdata/sf0.001").collect()))
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        want = {n: run(n) for n in names}
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert {n: run(n) for n in names} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
