"""Schemas of steps, events, macros, profiles and configuration, and the fixed names of directions and buttons."""

# Field names of the documents.
STEP = "type STRING, delay DOUBLE, dir STRING, btn STRING, rep INT, dur INT, gap INT, text STRING"
STEP_FULL = f"{STEP}, disabled_step STRUCT<{STEP.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE').replace(' INT', ': INT')}>"
STEPS = f"macro_id STRING, seq BIGINT, {STEP}"
EVENTS = "macro_id STRING, seq BIGINT, t DOUBLE, type STRING, id INT, val INT, hx INT, hy INT"
MACRO = f"name STRING, events ARRAY<STRUCT<t: DOUBLE, type: STRING, id: INT, val: VARIANT>>, steps ARRAY<STRUCT<{STEP_FULL}>>"
PROFILE = f"name STRING, trigger_btn INT, trigger_macro_idx INT, hotkey_binds MAP<STRING, INT>, macros ARRAY<STRUCT<{MACRO}>>"
KEY = "STRUCT<type: STRING, name: STRING, scan_code: INT>"
CONFIG = (
    f"play_guid STRING, rec_guid STRING, hotkey_keys MAP<STRING, {KEY}>, mirror_key {KEY}, active_profile_idx INT, monitor_on BOOLEAN, win_geometry STRING, "
    "target_window STRING, sec_process STRING, use_sec_proc BOOLEAN, sec_process_path STRING, btn_map MAP<STRING, INT>, saved_play_guid STRING, "
    "saved_play_name STRING, saved_rec_guid STRING, saved_rec_name STRING, sound_enabled BOOLEAN, custom_templates VARIANT"
)

# Directions by name with their vectors, left and right, and buttons in the order of their ids.
DIRECTIONS = {"↑上": (0, 1), "↓下": (0, -1), "←左": (-1, 0), "→右": (1, 0), "↗右上": (1, 1), "↘右下": (1, -1), "↖左上": (-1, 1), "↙左下": (-1, -1), "○中立": (0, 0)}
NEUTRAL = "○中立"
# Buttons that stand for a direction, by axis: those of 1 and of -1.
DIRECTION_BUTTONS = {"x": (14, 13), "y": (11, 12)}
BUTTONS = ["A", "B", "X", "Y", "LB", "RB", "Back", "Start", "L3", "R3", "Guide"]
# Defaults of a tap, and how near in ms an equal event counts as a repeat.
TAP = {"rep": 1, "dur": 50, "gap": 30}
REPEAT_MS = 20
