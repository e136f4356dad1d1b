from datetime import datetime, timedelta

from siftlog.streaming.sessions import session_stream

T0 = datetime(2026, 1, 1)
SCHEMA = "source string, host string, src_ip string, user string, event_type string, success boolean, ts timestamp"


def test_stream_sessions(spark, tmp_path):
    at = [0, 300, 601, 100_000]
    rows = [("s", "h", "i", "u", "sudo_command" if t == 601 else "ssh_auth_success", True, T0 + timedelta(seconds=t)) for t in at] + [("s", "h", None, "u", "x", True, T0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = session_stream(stream, 300).writeStream.outputMode("append").format("memory").queryName("sessions_out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["start_time"], r["event_count"], r["has_escalation"]) for r in spark.table("sessions_out").collect())
    assert got == [(T0, 2, False), (T0 + timedelta(seconds=601), 1, True)]
