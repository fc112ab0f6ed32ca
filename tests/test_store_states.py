"""Torn files, moves with a backup, saved names, minted ids, encoders, and content of any depth."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spoor.functions.text import flatten_json, flatten_value
from spoor.operators.identity import identity_facts
from spoor.plans.queries_names import NOW, told
from spoor.sources import store


def _unit(i, **more):
    return {"id": f"u{i}", "sessionId": "s", "cwd": "p", "role": "user", "text": f"note number {i}", "timestamp": NOW - i, **more}


def test_torn_files_stop_a_move(spark, tmp_path):
    (tmp_path / "old").mkdir()
    store.dump(str(tmp_path / "old/a.json"), {"units": [_unit(1, embedding=[0.6, 0.8]), _unit(2)], "embedder": "m"})
    (tmp_path / "old/b.json").write_text('{"units": [{"id": "u3", "te')
    new = store.UnitStore(spark, str(tmp_path / "new"))
    with pytest.raises(store.TornStore):
        store.migrate(spark, str(tmp_path / "old"), new)
    assert not (tmp_path / "new").exists()
    (tmp_path / "old/b.json").unlink()
    moved = store.migrate(spark, str(tmp_path / "old"), new, backup=str(tmp_path / "kept")).first()
    assert (moved["units"], moved["vectors"]) == (2, 1) and moved["bytes_before"] > 0 and moved["bytes_after"] > 0
    assert json.loads((tmp_path / "kept/a.json").read_text())["embedder"] == "m"
    assert new.load(model="m").where("embedding IS NOT NULL").count() == 1


def test_names_outlive_their_units_and_ids_differ(spark, tmp_path):
    held = store.UnitStore(spark, str(tmp_path / "s"))
    first = held.identity(identity_facts(told(spark))).first()
    assert (first["agent_name"], first["user_name"]) == ("vesper", "berit")
    # retention has taken the units; the names stay, and a newer one takes the place of its own only
    assert held.identity(identity_facts(told(spark).limit(0))).first()["agent_name"] == "vesper"
    newer = held.identity(identity_facts(told(spark).where("unit_id = 'n02'"))).first()
    assert (newer["agent_name"], newer["user_name"]) == ("vesper", "ada")
    ids = [r["unit_id"] for r in held.mint(told(spark).repartition(3), NOW).collect()]
    assert len(set(ids)) == len(ids) == 12 and all(i.startswith("u") and "_" in i for i in ids)


def test_encoders_plug_in(spark, tmp_path):
    @F.pandas_udf("array<double>")
    def letters(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(t.count(c)) for c in "aeiou"])

    held = store.UnitStore(spark, str(tmp_path / "s"))
    held.append(told(spark))
    held.embed(letters, "letters", limit=5)
    assert held.load(model="letters").where("embedding IS NOT NULL").count() == 5
    held.embed(letters, "letters")
    assert held.load(model="letters").where("embedding IS NULL").count() == 0
    more = store.enrich(told(spark), extractor=lambda t: F.when(t.contains("Ada"), F.array(F.lit("Ada"))).otherwise(F.array().cast("array<string>")))
    assert [r["unit_id"] for r in more.where("array_contains(ents, 'ada')").collect()] == ["n02"]


def test_content_of_any_depth(spark):
    deep = [{"type": "text", "text": "a"}, None, "b", {"type": "toolCall", "name": "run", "arguments": "x" * 300}, {"type": "toolCall", "name": "cut", "arguments": {"k": "y" * 300}},
            {"type": "toolResult", "content": [{"type": "toolResult", "content": [{"type": "text", "text": "deep"}]}]}, {"type": "image"}, {"text": "c"}]
    lines = flatten_value(deep).split("\n")
    assert lines[:3] == ["a", "b", "[tool:run] " + "x" * 300] and len(lines[3]) == len("[tool:cut] ") + 200 and lines[4:] == ["[result] [result] deep", "c"]
    rows = spark.createDataFrame([(json.dumps(deep),), ("plain",), ('"quoted"',), ("[torn",), (None,)], "c string")
    assert [r[0] for r in rows.select(flatten_json("c")).collect()] == [flatten_value(deep), "plain", "quoted", "[torn", ""]
