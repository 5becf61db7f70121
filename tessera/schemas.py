"""Canonical schemas of the engine's tables."""

from __future__ import annotations

STATE = "photo_id string, state string, iteration int, current_params string, last_measurement string, rule_hits string, next_action string, agent_decision string, qc_rollback_count int, updated_at timestamp"
TRACE = "id long, photo_id string, event_type string, param string, value string, reason string, rule_id string, formula string, source string, knowledge_ref string, meta_ref string, old_value string, new_value string, iteration int, timestamp timestamp, metadata string"
METRIC = "photo_id string, metric string, value double"
FRAME = "file_path string, datetime timestamp, focal_length double, aperture double, shutter_speed double, iso double"
BURST = "group_id string, files array<string>, frame_count int, is_standalone boolean, is_oversized boolean, parent_group_id string, skip_vlm boolean"
NODE = "id string, type string, label string, keywords array<string>, content string"
EDGE = "id string, `from` string, `to` string, relation string, weight double"
DOCUMENT = "id string, title string, content string, tags array<string>, source string"
REVIEW = "photo_id string, state string, unreliable_regions array<string>, rule_hits array<string>, before string, after string, agent_reason string, status string, created_at timestamp"
PIXEL = "image_id string, y int, x int, r double, g double, b double"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
