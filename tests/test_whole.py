"""Queries over the whole of their tables, on tables larger than what was once read of them."""

import numpy as np
from pyspark.sql import functions as F

from spoor.functions.text import entities
from spoor.llm import truncation
from spoor.operators import graph, retrieval, vector
from spoor.operators.retrieval import Options, retrieve
from spoor.plans import queries_search

FACT = "id string, text string, queries array<string>"


def test_all_vectors_are_dealt_out(spark, tmp_path):
    n = 601
    spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(f"f{i}", "text", ["a question"]) for i in range(n)], FACT).write.parquet(f"{tmp_path}/eval_facts.parquet")
    facts, asked = queries_search._fact_vectors(spark, str(tmp_path))
    assert {r["unit_id"]: r["embedding"][0] for r in facts.collect()} == {f"f{i}": float(i) for i in range(n)}
    assert {r["query_id"]: r["qvec"][0] for r in asked.collect()} == {f"f{i}:1": float(7 * i % n) for i in range(n)}


def test_the_whole_pipeline_is_given_every_similarity(spark, tmp_path, monkeypatch):
    n, seen = 260, {}
    spark.createDataFrame([(i, [1.0, i / n], 0) for i in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(f"f{i}", "text", ["a question"] if i < 3 else None) for i in range(n)], FACT).write.parquet(f"{tmp_path}/eval_facts.parquet")
    monkeypatch.setattr(queries_search, "retrieve", lambda q, u, o, dense, **_: seen.setdefault("dense", dense).withColumn("score", F.lit(0.0)))
    monkeypatch.setattr(vector, "SCORES", 100)
    queries_search.retrieve_full(spark, str(tmp_path))
    got = {(r["query_id"], r["unit_id"]): r["sem"] for r in seen["dense"].collect()}
    assert set(got) == {(f"f{q}:1", f"f{u}") for q in range(3) for u in range(n)} and seen["dense"].count() == 3 * n
    cos = lambda a, b: (1 + a * b) / ((1 + a * a) * (1 + b * b)) ** 0.5
    assert all(abs(got[f"f{q}:1", f"f{u}"] - (cos(7 * q / n, u / n) + 1) / 2) < 1e-6 for q in range(3) for u in range(n))


def test_similar_entities_seed_the_graph(spark):
    units = spark.createDataFrame(
        [("a", "s1", None, "p", "user", "`auth_gate` opens", 1, 0), ("b", "s2", None, "p", "user", "`auth_door` shuts", 2, 1), ("c", "s3", None, "p", "user", "`auth_wall` stands", 3, 2), ("d", "s4", None, "p", "user", "`other_thing` too", 4, 3)],
        "unit_id string, session_id string, session_name string, cwd string, role string, text string, ts long, seq long",
    ).withColumn("ents", entities(F.col("text")))
    asked = spark.createDataFrame([("q", "what about `auth_gate` opens", "p", None, 9)], "query_id string, text string, cwd string, session_id string, now long")
    # near and with a word in common; with a word only; near only
    vec = spark.createDataFrame([("auth gate", [1.0, 0.0]), ("auth door", [0.8, 0.6]), ("auth wall", [0.6, 0.8]), ("other", [1.0, 0.0])], "entity string, embedding array<double>")
    q_ents = spark.createDataFrame([("q", "auth gate")], "query_id string, entity string")
    held = spark.createDataFrame([("a", "auth gate"), ("b", "auth door"), ("c", "auth wall"), ("d", "other")], "unit_id string, entity string")
    got = {(r["query_id"], r["unit_id"]): r["seed"] for r in graph.similar_hits(q_ents, held, vec).collect()}
    assert set(got) == {("q", "b")} and abs(got["q", "b"] - 0.8) < 1e-9
    units = units.withColumn("ents", F.transform("ents", lambda e: F.translate(e, "_", "-")))
    asked = asked.withColumn("text", F.translate("text", "_", "-"))
    # the least mass counts 0, here that of "c"
    vec = spark.createDataFrame([("auth-gate", [1.0, 0.0]), ("auth-door", [0.8, 0.6]), ("auth-wall", [0.71, 0.7])], "entity string, embedding array<double>")
    found = lambda v: {r["unit_id"]: r["reason"] for r in retrieve(asked, units, Options(min_score=0.01, use_closure=False), entity_vectors=v).collect()}
    assert "b" not in found(None) and found(vec)["b"].startswith("graph")


def test_low_masses_are_kept(spark, tmp_path):
    n = 1200
    spark.createDataFrame([(i, "about `auth_gate`") for i in range(n)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("f0", "text", ["what about `auth_gate`"])], FACT).write.parquet(f"{tmp_path}/eval_facts.parquet")
    mass = [r["mass"] for r in queries_search.ppr_mass(spark, str(tmp_path)).collect()]
    assert len(mass) == n and abs(sum(mass) - 1) < 1e-9 and abs(mass[0] - 1 / n) < 1e-9


def test_every_near_copy_of_a_bucket_is_compared(spark):
    rng = np.random.default_rng(4)
    words = lambda k: ["".join(rng.choice(list("abcdefghijklmnop"), 9)) for _ in range(k)]
    rows, want = [], set()
    for i in range(6):
        full = " ".join(words(60)) + "."
        # cut within its last word, so of as many words as its copy
        rows += [(f"tie{i}", full[:-5]), (f"full{i}", full)]
        want.add(f"tie{i}")
    base = words(56)
    rows += [("short", " ".join(base)), ("copy", " ".join(base + words(4)) + ".")]
    # longer texts of the same buckets that are no near-copies
    rows += [(f"long{i}", " ".join(base + words(45)) + ".") for i in range(60)]
    df = spark.createDataFrame([(u, t, "user") for u, t in rows], "unit_id string, text string, role string")
    got = {r["unit_id"] for r in truncation.truncation(df).collect() if r["verdict"] == "cut by its copy"}
    assert got == want | {"short"}


def test_a_copy_that_does_not_go_on_hides_no_other(spark):
    """A text whose first partners end as it does, or go on after a full stop, still meets the one that goes on in mid-sentence."""
    rng = np.random.default_rng(5)
    words = lambda k: ["".join(rng.choice(list("abcdefghijklmnop"), 9)) for _ in range(k)]
    base = words(60)
    short = " ".join(base)
    rows = [(1, short), (2, short + " " + " ".join(words(9)) + " and")]
    # as near as that, but of other ends, in length before and behind the one that goes on
    rows += [(10 + i, " ".join([*base[:-2], *words(2 + i)])) for i in range(5)]
    rows += [(30 + i, " ".join([*base[:-2], *words(14 + i)])) for i in range(5)]
    got = {r["th"]: r["whole"] for r in truncation.near_copies(spark.createDataFrame(rows, "th long, text string")).collect()}
    assert got.get(1) == 0


def _asked_and_units(spark, n_units: int, n_asked: int):
    rng = np.random.default_rng(8)
    units = spark.createDataFrame(
        [(f"u{i}", f"s{i % 9}", None, "p" if i % 3 else "o", "user", "common words and " + " ".join(f"w{x}" for x in rng.integers(0, 60, 6)) + f" `thing_{i % 40}`", i, i, [float(x) for x in rng.normal(size=4)]) for i in range(n_units)],
        "unit_id string, session_id string, session_name string, cwd string, role string, text string, ts long, seq long, embedding array<double>",
    ).withColumn("ents", entities(F.col("text")))
    asked = spark.createDataFrame([(f"q{i}", f"common words of w{i} with w{i + 20}", "p", None, n_units) for i in range(n_asked)], "query_id string, text string, cwd string, session_id string, now long")
    return asked, units


def _written(monkeypatch, frames):
    held, real = {}, retrieval.materialize

    def counted(df, name):
        out = real(df, name)
        held[name] = max(held.get(name, 0), out.count())
        return out

    monkeypatch.setattr(retrieval, "materialize", counted)
    rows = frames()
    return held, rows


def test_no_pair_of_query_and_unit_is_written(spark, monkeypatch):
    asked, units = _asked_and_units(spark, 400, 20)
    held, rows = _written(monkeypatch, lambda: retrieve(asked, units, Options(use_mmr=False, use_bridges=False)).collect())
    # each query meets each unit by its first words
    assert len(rows) == 20 * 5 and max(held.values()) < 20 * 400 / 4, held


def test_vectors_compared_in_the_tasks_give_what_all_similarities_give(spark, monkeypatch):
    asked, units = _asked_and_units(spark, 300, 20)
    rng = np.random.default_rng(9)
    qvec = spark.createDataFrame([(f"q{i}", [float(x) for x in rng.normal(size=4)]) for i in range(20)], "query_id string, qvec array<double>")
    dense = vector.similarities(qvec, units).select("query_id", "unit_id", ((F.col("cosine") + 1) / 2).alias("sem"))
    rows = lambda **found: sorted((r["query_id"], r["rank"], r["unit_id"], round(r["score"], 6), r["reason"]) for r in retrieve(asked, units, Options(), **found).collect())
    held, got = _written(monkeypatch, lambda: rows(asked_vectors=qvec))
    assert got == rows(dense=dense) and len(got) == 20 * 5 and max(held.values()) < 20 * 300 / 2, held

