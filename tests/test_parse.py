import random
from datetime import datetime

import pytest

from siftlog.operators import parse
from siftlog.sources import files

H = "Apr 17 06:12:45 edge3 sshd[7315]: "
CASES = [
    (H + "Accepted password for mira from 172.16.8.20 port 41877 ssh2", dict(event_type="ssh_auth_success", user="mira", src_ip="172.16.8.20", src_port=41877, method="password", success=True)),
    (H + "Failed password for invalid user oper from 198.51.100.27 port 39005 ssh2", dict(event_type="ssh_auth_failure_invalid_user", user="oper", success=False)),
    ("2026-04-17T06:12:45.654321+00:00 edge3 sshd[7315]: Accepted publickey for mira from 1.2.3.4 port 5 ssh2: RSA SHA256:q9Zt4w", dict(method="publickey", key_fingerprint="RSA SHA256:q9Zt4w")),
    ("Apr 17 06:12:45 edge3 sudo:     mira : TTY=pts/1 ; PWD=/home/mira ; USER=root ; COMMAND=/bin/bash", dict(event_type="sudo_command", target_user="root", tty="pts/1", pwd="/home/mira", command="/bin/bash", success=True)),
    (H + "pam_unix(sshd:session): session opened for user mira(uid=1000) by (uid=0)", dict(event_type="session_opened", uid=1000, success=True)),
    (H + "new user: name=cachebot, UID=0, GID=0, home=/x", dict(event_type="account_created", new_account="cachebot", uid=0, success=None)),
    (H + "Invalid user oper from 198.51.100.27", dict(event_type="invalid_user", src_port=None, success=False)),
    (H + "Failed password for oper from 198.51.100.27 ssh2", dict(event_type="ssh_auth_failure", src_port=None)),
    (H + "Connection closed by 198.51.100.27 [preauth]", dict(event_type="connection_closed_by_ip", success=False)),
    (H + "pam_unix(imapd:auth): authentication failure; logname= uid=0 ruser=x rhost=192.168.7.81  user=t.ortega", dict(event_type="auth_failure", src_ip="192.168.7.81", user="t.ortega")),
    (H + "pam_unix(imapd:auth): authentication failure; logname= rhost=  user=tom", dict(event_type="auth_failure", src_ip=None, user=None)),
    (H + "reverse mapping checking getaddrinfo for scan.example.org [198.51.100.27] failed - POSSIBLE BREAK-IN ATTEMPT!", dict(event_type="reverse_mapping_check", src_ip="198.51.100.27")),
    (H + "input_userauth_request: invalid user oper [preauth]", dict(event_type="input_userauth_request", user="oper")),
    ("!!! not a syslog line !!!", dict(reason="Unrecognized header")),
    (H + "Accepted password for from 172.16.8.20 port 41877 ssh2", dict(reason="Unrecognized auth message family")),
    ("", dict(reason="Empty line")),
]
SCHEMA = "source string, line_no bigint, raw_line string, default_year int, zone string, dst_fold int"


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("s", i, line, 2026, "UTC", None) for i, (line, _) in enumerate(CASES, 1)]
    return {r["line_no"]: r for r in parse.parse_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_line(parsed, i):
    row = parsed[i + 1]
    for k, want in CASES[i][1].items():
        assert row[k] == want, (k, row)
    assert (row["reason"] is None) == ("reason" not in CASES[i][1])


def test_header_fields(parsed):
    assert (parsed[1]["host"], parsed[1]["process"], parsed[1]["pid"]) == ("edge3", "sshd", 7315)
    assert parsed[1]["timestamp"] == datetime(2026, 4, 17, 6, 12, 45)
    assert parsed[3]["timestamp"] == datetime(2026, 4, 17, 6, 12, 45, 654321)


def stamps(spark, lines, year=2024, zone="UTC", fold=None):
    rows = [("s", i, f"{x} h sshd[1]: Invalid user a from 1.1.1.1", year, zone, fold) for i, x in enumerate(lines, 1)]
    return [(r["timestamp"], r["reason"]) for r in parse.parse_lines(spark.createDataFrame(rows, SCHEMA)).orderBy("line_no").collect()]


def test_year_rollover(spark):
    got = stamps(spark, ["Dec 31 23:59:59", "2025-01-01T00:00:02+00:00", "Jan  1 00:00:01"])
    assert [g[0] for g in got] == [datetime(2024, 12, 31, 23, 59, 59), datetime(2025, 1, 1, 0, 0, 2), datetime(2025, 1, 1, 0, 0, 1)]
    got = stamps(spark, ["Dec 31 23:59:59", "Jan  1 00:00:01"])
    assert got[1][0] == datetime(2025, 1, 1, 0, 0, 1)


def test_daylight_saving(spark):
    assert stamps(spark, ["Nov  3 01:30:00"], zone="America/New_York")[0] == (None, "Ambiguous local timestamp")
    assert stamps(spark, ["Nov  3 01:30:00"], zone="America/New_York", fold=1)[0][0] == datetime(2024, 11, 3, 6, 30)
    assert stamps(spark, ["Nov  3 01:30:00"], zone="America/New_York", fold=0)[0][0] == datetime(2024, 11, 3, 5, 30)
    assert stamps(spark, ["Mar 10 02:30:00"], zone="America/New_York")[0] == (None, "Nonexistent local timestamp")
    assert stamps(spark, ["Jul  1 12:00:00"], zone="America/New_York")[0][0] == datetime(2024, 7, 1, 16, 0)


def test_bad_stamps(spark):
    assert stamps(spark, ["Feb 29 10:00:00"], year=2023)[0] == (None, "Invalid timestamp")
    assert stamps(spark, ["Xyz  1 10:00:00"])[0] == (None, "Invalid timestamp")
    assert stamps(spark, ["Feb 20 10:00:00"], year=None)[0] == (None, "Missing year")


def test_every_line_in_one_output(spark):
    rows = [("s", i, line, 2026, "UTC", None) for i, (line, _) in enumerate(CASES, 1)]
    p = parse.parse_lines(spark.createDataFrame(rows, SCHEMA))
    assert parse.events_of(p).count() + parse.failures_of(p).count() == len(CASES)


def replay(rows, year):
    """Plain state machine over the stamps of one source."""
    out, last = {}, None
    for n, stamp in rows:
        if stamp and stamp[0].isdigit():
            year, last = int(stamp[:4]), int(stamp[5:7])
        elif stamp:
            month = parse.MONTHS.index(stamp[:3]) // 3 + 1
            year += last is not None and last >= 11 and month <= 2
            last = month
        out[n] = year
    return out


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_years_over_chunks(spark, chunk):
    """The scan gives what a replay gives, wherever chunks end, for sources of one line and of many."""
    r, rows, want = random.Random(4), [], {}
    for s in range(12):
        own = []
        for n in range(1, r.choice([2, 40, 90])):
            month = r.choice(["Jan", "Feb", "Nov", "Dec", "Dec", "Jun"])
            own.append((n, r.choice([None, f"{month}  3 10:00:00", f"{month} 13 10:00:00", f"{month} 13 10:00:00", f"20{r.randint(10, 30)}-{r.choice(['01', '11', '12'])}-02T00:00:00Z"])))
        want |= {(f"s{s}", n): y for n, y in replay(own, 2020 + s).items()}
        rows += [(f"s{s}", n, stamp, 2020 + s) for n, stamp in own]
    r.shuffle(rows)
    got = parse.with_years(spark.createDataFrame(rows, "source string, line_no bigint, stamp string, default_year int"), chunk).collect()
    assert {(x["source"], x["line_no"]): x["year"] for x in got} == want


def test_fields_of_a_record_survive_files(spark, tmp_path):
    """Parse, write, read: all columns of the schema, absent ones null; signs that join the groups may be in a line."""
    lines = [H + "Accepted password for a\x01b from 10.0.0.9 port 7 ssh2", H + "Removed session 4."]
    rows = [("s", i, line, 2026, "UTC", None) for i, line in enumerate(lines, 1)]
    events = parse.events_of(parse.parse_lines(spark.createDataFrame(rows, SCHEMA)))
    files.write_events(events, str(tmp_path / "e"))
    got = files.read_events(spark, str(tmp_path / "e")).orderBy("line_no").collect()
    assert [(x["user"], x["src_port"], x["ruser"], x["session_hint"]) for x in got] == [("a\x01b", 7, None, None), (None, None, None, None)]


def test_failures_keep_their_time(spark):
    rows = [("s", 1, H + "something unknown", 2026, "UTC", None), ("s", 2, "no header", 2026, "UTC", None)]
    got = parse.failures_of(parse.parse_lines(spark.createDataFrame(rows, SCHEMA))).orderBy("line_no").collect()
    assert [x["timestamp"] for x in got] == [datetime(2026, 4, 17, 6, 12, 45), None]
