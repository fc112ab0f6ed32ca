"""Stores on disk, legacy imports, dialogues, run files, settings."""

import json

import pytest
from pyspark.sql import functions as F

from spoor.functions.text import flatten_blocks
from spoor.sources import store

RAW = "unit_id string, session_id string, session_name string, cwd string, role string, text string, ts long, seq long"


def raw(spark, ids, cwd="p"):
    return spark.createDataFrame([(u, "s", None, cwd, "user", f"text of {u}", 1_000 + i, i) for i, u in enumerate(ids)], RAW)


def test_append_merge_and_clear(spark, tmp_path):
    mine, other = (store.UnitStore(spark, str(tmp_path / n)) for n in ("a", "b"))
    assert mine.load().count() == 0
    mine.append(raw(spark, ["u1", "u2"]))
    mine.append(raw(spark, ["u2", "u3"], "q"))
    other.append(raw(spark, ["u3", "u4"]))
    mine.merge(other.load())
    rows = {r["unit_id"]: r for r in mine.load().collect()}
    assert set(rows) == {"u1", "u2", "u3", "u4"} and rows["u1"]["tokens"] == ["text", "u1"]
    mine.save_vectors(spark.createDataFrame([("u1", [3.0, 4.0])], "unit_id string, embedding array<double>"), "m")
    got = {r["unit_id"]: r["embedding"] for r in mine.load(model="m").collect()}
    assert got["u1"] == pytest.approx([0.6, 0.8], abs=0.005) and got["u2"] is None
    assert mine.load(model="other").where("embedding is not null").count() == 0
    assert mine.missing_vectors(limit=2, model="m").count() == 2
    assert store.UnitStore(spark, mine.path, max_units=1).load(now_ms=2_000).count() == 1
    mine.clear()
    assert mine.load().count() == 0


def test_migration(spark, tmp_path):
    units = [{"id": f"u{i}", "sessionId": "s", "cwd": "p", "role": "user", "text": f"some `name_{'abc'[i]}`", "timestamp": 5, "embedding": [1.0, 0.0] if i else None} for i in range(3)]
    store.dump(str(tmp_path / "old.json"), {"units": units, "embedder": "m", "counter": 3})
    new = store.UnitStore(spark, str(tmp_path / "new"))
    moved = store.migrate(spark, str(tmp_path / "old.json"), new).first()
    assert (moved["units"], moved["vectors"]) == (3, 2)
    assert new.load(model="m").where("embedding is not null").count() == 2
    (tmp_path / "torn.json").write_text('{"units": [{"id": ')
    assert store.read_legacy(spark, str(tmp_path / "torn.json")).count() == 0


def test_dialogues(spark, tmp_path):
    sample = {
        "sample_id": "c1",
        "conversation": {"session_10": [{"dia_id": "D10:1", "text": "late"}], "session_2": [{"dia_id": "D2:1", "text": "hi"}, {"dia_id": "D2:2", "text": "yo"}], "session_2_date_time": "1 May"},
        "qa": [{"question": "who", "answer": "me", "category": 1, "evidence": ["D2:1"]}],
    }
    (tmp_path / "d.json").write_text(json.dumps([sample]))
    turns, questions = store.read_dialogues(spark, str(tmp_path / "d.json"))
    assert [r["dia_id"] for r in turns.orderBy("session", "turn").collect()] == ["D2:1", "D2:2", "D10:1"]
    assert questions.first()["evidence"] == ["D2:1"]


def test_runs_must_match(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.1)], "i int, q string, f1 double")
    assert store.paired_runs(a, a).count() == 2
    with pytest.raises(ValueError):
        store.paired_runs(a, a.where("i = 1"))


def test_flatten_blocks(spark):
    blocks = "b array<struct<type:string,text:string,name:string,arguments:string,content:string>>"
    df = spark.createDataFrame([([("text", "hi", None, None, None), None, ("toolCall", None, "bash", "x" * 300, None), ("toolResult", None, None, None, "ok")],)], blocks)
    assert df.select(flatten_blocks(F.col("b")).alias("t")).first()["t"] == f"hi\n[tool:bash] {'x' * 300}\n[result] ok"


@pytest.mark.parametrize("raw, want", [("3", 3), ("", 7), (None, 7), ("abc", 7), ("inf", 7), ("99", 10), ("0", 0)])
def test_numbers(raw, want):
    assert store.number(raw, 7, 0, 10) == want
    assert store.token_estimate(9) == 3
