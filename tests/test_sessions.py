"""Sessions in append mode: given once, when closed, across restarts."""

import datetime as dt

from gatewise.streaming import live


def test_sessions_are_given_once_they_are_closed(spark, tmp_path):
    schema = "row_id bigint, user_id bigint, ts timestamp_ntz, decision string"
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    source, out = str(tmp_path / "source"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame([(i, u, at(m), d) for i, (u, m, d) in enumerate(rows)], schema).coalesce(1).write.mode("append").parquet(source)
        return drained()

    def drained():
        stream = live.replay_source(spark, source, spark.read.parquet(source).schema)
        table = live.run_to_table(live.login_sessions(stream), out)
        return sorted((r.user_id or 0, r.session_start, r.session_end, r.events, r.not_allowed) for r in table.collect())

    assert run([(1, 0, "allow"), (2, 5, "block"), (1, 20, "block"), (None, 21, "allow")]) == []
    # User 1 goes on in the next run; user 2 comes back after the gap.
    closed = run([(1, 45, "allow"), (2, 100, "allow")])
    first = [(0, at(21), at(51), 1, 0), (1, at(0), at(75), 3, 1), (2, at(5), at(35), 1, 1)]
    assert closed == first
    # A login older than the watermark is late and changes nothing.
    assert run([(1, 50, "block")]) == first
    live.mark_end(spark, source, spark.read.parquet(source).schema)
    assert drained() == [*first, (2, at(100), at(130), 1, 0)]
