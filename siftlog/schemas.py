"""Explicit schemas of the record types; nothing is inferred from data."""

from __future__ import annotations

EVENT_SCHEMA = (
    "event_id string, source string, line_no bigint, timestamp timestamp, host string, process string, pid bigint, "
    "event_type string, message string, raw_message string, success boolean, user string, src_ip string, src_port bigint, "
    "method string, key_fingerprint string, command string, tty string, pwd string, uid bigint, target_user string, "
    "ruser string, new_account string, added_group string, session_hint string"
)
SESSION_SCHEMA = (
    "session_id string, source string, host string, src_ip string, user string, start_time timestamp, end_time timestamp, "
    "event_count bigint, events array<string>, primary_method string, key_fingerprint string, src_port bigint, "
    "has_escalation boolean, has_persistence boolean, failure_count bigint, gap_seconds double"
)
FAILURE_SCHEMA = "source string, line_no bigint, raw_line string, reason string, timestamp timestamp"
LABEL_SCHEMA = "source string, line_no bigint, attack boolean, attack_family string, technique_ids array<string>"
