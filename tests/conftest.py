import pytest

from gatewise.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def events(spark):
    """Build clean-like login rows: events([(row_id, user, 'ts', changes)])."""
    columns = (
        "row_id bigint, user_id bigint, ts timestamp_ntz, login_success boolean, is_attack_ip boolean, "
        "is_ato boolean, ip string, country string, asn bigint, device_type string, os_family string, "
        "browser_family string"
    )
    base = dict(login_success=True, is_attack_ip=False, is_ato=False, ip="1.1.1.1", country="NO", asn=1,
                device_type="desktop", os_family="Linux", browser_family="Firefox")

    def build(rows):
        import datetime as dt

        out = []
        for row_id, user, ts, *rest in rows:
            values = {**base, **(rest[0] if rest else {})}
            when = dt.datetime.fromisoformat(ts) if isinstance(ts, str) else ts
            out.append((row_id, user, when, *values.values()))
        return spark.createDataFrame(out, columns)

    return build
