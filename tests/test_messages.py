"""Messages of unknown kinds become rows without a schema change."""

import json

from pyspark.sql import functions as F

from spindrift.sources import behaviour_log, messages

LINES = [
    {"time": 0.5, "behavior_controller": {"context": {"id": "a", "action": "start"}}},
    {"time": 1.5, "optogenetics": {"laser": 473, "power": 2.5}, "note": "x"},
    {"time": 2.5, "optogenetics": {"laser": 561, "power": "high", "extra": [1, 2]}},
    {"time": 3.5, "note": 'he said "settings" twice'},
    {"time": 3.5, "note": "older"},
    {"version": 3},
]
RAW = [*map(json.dumps, LINES), "", "{broken", "[1, 2]", "17", "null"]


def made(spark):
    return spark.createDataFrame([("f", x) for x in RAW] + [("g", RAW[1])], "file string, value string")


def test_an_unknown_kind_becomes_rows(spark):
    found = messages.parts(messages.messages(made(spark)))
    got = {(r["file"], r["t"], r["kind"], r["b"]) for r in found.select("file", "t", "kind", F.to_json("body").alias("b")).collect()}
    want = {(f, m.get("time"), k, json.dumps(v, separators=(",", ":"), sort_keys=True)) for f, ms in (("f", LINES), ("g", LINES[1:2])) for m in ms for k, v in m.items() if k != "time"}
    assert got == want
    assert {r["broken"] for r in messages.unreadable(made(spark)).collect()} == {"{broken", "[1, 2]", "17", "null"}


def test_handlers_by_name_and_the_rest(spark):
    found = messages.parts(messages.messages(made(spark)))
    seen = messages.routed(found, {"optogenetics": messages.fields({"laser": "int", "power": "double"}), "absent": lambda df: df}, messages.trial_info)
    assert sorted(map(tuple, seen["optogenetics"].collect())) == [("f", 1.5, 473, 2.5), ("f", 2.5, 561, None), ("g", 1.5, 473, 2.5)]
    assert seen["absent"].count() == 0
    info = {(r["file"], r["name"]): r["value"] for r in seen[""].collect()}
    assert info["f", "note"] == '"older"' and info["f", "version"] == "3" and ("f", "optogenetics") not in info
    kinds = {(r["kind"], r["path"], r["type"]): r["n"] for r in messages.leaves(messages.messages(made(spark))).where("file = 'f'").collect()}
    assert kinds["optogenetics", "laser", "BIGINT"] == 2 and kinds["note", None, "STRING"] == 3
    none = made(spark).limit(0)
    assert messages.parts(messages.messages(none)).count() == 0


def test_a_message_that_mentions_settings_stays(spark):
    lines = spark.createDataFrame([("f", json.dumps(x)) for x in ({"time": 1.0, "y": 3.0, "note": 'the "settings" were fine'}, {"settings": {"sync_pin": 4}}, {"time": 2.0, "settings": {}})], "file string, value string")
    assert [(r["time"], r["y"]) for r in behaviour_log.parsed(lines).collect()] == [(1.0, 3.0)]
    assert behaviour_log.broken_lines(lines).count() == 0
    assert [r["sync_pin"] for r in behaviour_log.settings(lines).collect()] == [4, None]
