"""Schemas of the engine's tables."""

from __future__ import annotations

FRAMES = "session_id string, idx long, t double, height int, width int, channels int, data binary"
READINGS = "session_id string, t double, anomaly_id string, intensity double, threshold double, detector string"
THRESHOLDS = "session_id string, detector string, anomaly_id string, threshold double"
BOX = "struct<x:int,y:int,w:int,h:int>"
EVENTS = f"id long, session_id string, anomaly_id string, detector string, start double, `end` double, duration double, max_intensity double, threshold double, timeline array<struct<t:double,v:double>>, metadata string, regions array<{BOX}>, media string"
SESSIONS = "id string, name string, started_at double, finished_at double, source string, fps double, status string"
CALIBRATIONS = "session_id string, completed_at double, thresholds map<string,map<string,double>>, annotations string, media string"
SCHEDULE = "key string, start double, `end` double, expected_pattern string"
