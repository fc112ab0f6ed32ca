"""Operators on hand-made units, and the registered queries against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.functions.text import entities, fingerprint
from spoor.operators import evaluation, graph, identity, lexical, ranking
from spoor.operators.answers import calibrate, evidence_block
from spoor.operators.ranking import top_k
from spoor.operators.retrieval import Options, retrieve
from spoor.operators.vector import CellIndex, exact_topk
from spoor.plans import catalog
from spoor.sources import units as store
from spoor.streaming.ingest import captured

NOW = 1_700_000_000_000
UNIT = "unit_id string, session_id string, session_name string, cwd string, role string, text string, ts long, seq long"
QUERY = "query_id string, text string, cwd string, session_id string, now long"


def make(spark, rows):
    full = [(u, s, None, c, r, t, NOW - age, i) for i, (u, s, c, r, t, age) in enumerate(rows)]
    return spark.createDataFrame(full, UNIT).withColumn("ents", entities(F.col("text")))


def ask(spark, units, text, cwd="p", session=None, context=None, **options):
    q = spark.createDataFrame([("q", text, cwd, session, NOW)], QUERY)
    rows = retrieve(q, units, Options(**options), context=context).orderBy("rank").collect()
    return [(r["unit_id"], r["reason"]) for r in rows]


DAY = 86_400_000


def test_graph_and_closure_bring_what_words_cannot(spark):
    u = make(spark, [
        ("a", "s1", "p", "user", "the login page talks to `auth_gate` for tickets", DAY), ("b", "s2", "p", "assistant", "`auth_gate` rejects old browsers", DAY),
        ("c", "s3", "p", "user", "lunch menu was soup", DAY), ("d", "s1", "p", "assistant", "fine, noted", DAY - 1),
    ])
    found = dict(ask(spark, u, "login page tickets"))
    assert "a" in found and found["b"] == "closure:shared-entity" and "c" not in found
    assert "b" not in dict(ask(spark, u, "login page tickets", use_closure=False))


def test_recency_is_session_scoped(spark):
    u = make(spark, [("new", "A", "p", "user", "the deploy password is otter", 5_000), ("old", "A", "p", "user", "weather is fine today", 600_000)])
    assert "new" in dict(ask(spark, u, "deploy password", session="B")) and "new" in dict(ask(spark, u, "deploy password"))
    assert "new" not in dict(ask(spark, u, "deploy password", session="A"))


def test_federation(spark):
    rows = [("x", "s1", "other", "user", "the kafka broker lives on port nine", DAY), ("y", "s2", "p", "user", "completely different stuff", DAY)]
    u = make(spark, rows)
    assert dict(ask(spark, u, "kafka broker port"))["x"].endswith("+cross-project")
    assert ask(spark, u, "kafka broker port", federate=False) == []
    own = make(spark, [*rows, ("z", "s3", "p", "user", "our kafka broker port is ten", DAY)])
    assert set(dict(ask(spark, own, "kafka broker port"))) == {"z"}


def test_context_and_duplicates(spark):
    u = make(spark, [("a", "s1", "p", "user", "The rocket uses LOX!", DAY), ("b", "s2", "p", "user", "the rocket uses lox", DAY), ("c", "s3", "p", "user", "nothing", DAY)])
    assert len(ask(spark, u, "rocket lox")) == 1
    seen = u.where("unit_id = 'a'").select(F.lit("q").alias("query_id"), fingerprint(F.col("text")).alias("fp"))
    assert ask(spark, u, "rocket lox", context=seen) == []
    assert ask(spark, u, "the of and") == []


def test_names_and_perspective(spark):
    u = make(spark, [
        ("u1", "s", "p", "user", "my name is mark.", 9 * DAY), ("u2", "s", "p", "user", "I'll call you Echo", 8 * DAY), ("u3", "s", "p", "assistant", "you can just call me Pi", 7 * DAY),
        ("u4", "s", "p", "assistant", "I'm Nova, as agreed", 6 * DAY), ("u5", "s", "p", "user", "let's go with exponential backoff", 5 * DAY),
    ])
    facts = identity.identity_facts(u).first()
    assert (facts["agent_name"], facts["agent_source"], facts["user_name"]) == ("nova", "self-named", "mark")
    line = identity.identity_facts(u).select(identity.identity_line(F.lit("6d ago")).alias("l")).first()["l"]
    assert line == '- Identity: the assistant\'s name is "nova" (self-named 6d ago) — use this name when asked; the user\'s name is "mark"'
    nobody = identity.identity_facts(u.where("unit_id = 'u5'"))
    assert nobody.first()["agent_name"] is None
    kept = identity.sticky_identity(nobody, identity.identity_facts(u)).first()
    assert kept["agent_name"] == "nova" and kept["user_name"] == "mark"
    scores = {r["unit_id"]: r["x"] for r in u.select("unit_id", identity.perspective(F.lit("you"), F.col("role"), F.col("text"), identity.naming_match("text")).alias("x")).collect()}
    assert scores["u2"] == 1.0 and scores["u3"] == -0.5 and scores["u4"] == 1.0 and scores["u1"] == -1.0
    found = dict(ask(spark, u, "what is my name?"))
    assert "u1" in found and "u3" not in found


@pytest.mark.parametrize("text, want", [
    ("I'm going to call me back later", None), ("well, I'm Echo now", ("echo", False)), ("Call me Pi", ("pi", True)), ("call me back. my name is Ada", ("ada", False)), (None, None),
])
def test_first_naming(text, want):
    got = identity.first_naming(text)
    assert (got and (got["name"], got["default_name"])) == want


def test_ppr_equals_the_matrix_form(spark):
    sets = {"a": ["x_a", "y_a"], "b": ["x_a"], "c": ["y_a", "z_a"], "d": ["z_a"], "e": ["lone_a"]}
    postings = spark.createDataFrame([(u, e) for u, es in sets.items() for e in es], "unit_id string, entity string")
    weights = graph.entity_weights(postings, spark.createDataFrame([(5,)], "n_units long"))
    names = sorted(sets)
    w = np.zeros((5, 5))
    for r in graph.edges(postings, weights).collect():
        w[names.index(r["src"]), names.index(r["dst"])] = r["w"]
    seed = np.array([1.0, 0, 0, 0, 1.0])
    r = p = seed / seed.sum()
    for _ in range(24):
        rows = w.sum(1)
        p = 0.4 * r + 0.6 * (np.where(rows > 0, p / np.maximum(rows, 1e-12), 0) @ w + np.where(rows > 0, 0, p))
    seeds = spark.createDataFrame([("q", "a", 1.0), ("q", "e", 1.0)], "query_id string, unit_id string, seed double")
    got = {x["unit_id"]: x["mass"] for x in graph.ppr(seeds, postings, weights, least=0).collect()}
    assert np.allclose([got.get(n, 0) for n in names], p, atol=1e-9)
    # amounts that stay where they are when small change little, and nothing of the whole
    got = {x["unit_id"]: x["mass"] for x in graph.ppr(seeds, postings, weights).collect()}
    assert np.allclose([got.get(n, 0) for n in names], p, atol=2e-3) and abs(sum(got.values()) - 1) < 1e-9


def test_diversity():
    items = [(np.array([1.0, 0]), frozenset()), (np.array([1.0, 0.01]), frozenset()), (np.array([0, 1.0]), frozenset())]
    assert ranking.select_diverse([1.0, 0.99, 0.6], items, 2, 0.7) == [0, 2]
    assert ranking.select_diverse([1.0, 0.99, 0.6], items, 2, 0.0) == [0, 1]
    words = [(None, frozenset("ab")), (None, frozenset("ab")), (None, frozenset("cd"))]
    assert ranking.select_diverse([1.0, 1.0, 0.9], words, 3, 0.5) == [0, 2, 1]


def test_vector_search(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(10, 8))[rng.integers(0, 10, 400)] + 0.3 * rng.normal(size=(400, 8))
    df = spark.createDataFrame([(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "unit_id string, embedding array<double>")
    asked = df.where("unit_id < 'v020'").select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("qvec"))
    exact = {(r["query_id"], r["unit_id"]) for r in exact_topk(asked, df, 10).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert exact == {(f"v{i:03d}", f"v{j:03d}") for i in range(20) for j in np.argsort(-(n @ n[i]))[:10]}
    index = CellIndex(df.where("unit_id <> 'v007'"), cells=10)
    index.add(df.where("unit_id = 'v007'"))
    index.save(str(tmp_path / "index"))
    index = CellIndex.read(spark, str(tmp_path / "index"))
    index.remove(df.where("unit_id = 'v399'"))
    assert index.vectors.count() == 399 and index.vectors.where("unit_id = 'v399'").count() == 0
    near = {(r["query_id"], r["unit_id"]) for r in index.topk(asked, 10, 5).collect()}
    assert len(near & exact) / len(exact) >= 0.85 and ("v007", "v007") in near


def test_store(spark, tmp_path):
    u = make(spark, [("a", "s", "p", "user", "one", 1), ("b", "s", "p", "user", "two", 1), ("c", "s", "p", "tool", "x" * 900, 100 * DAY), ("d", "s", "p", "tool", "y" * 900, 5), ("e", "s", "p", "user", "?!", 5)])
    assert [r["unit_id"] for r in store.retain(u, NOW, max_units=2).orderBy("unit_id").collect()] == ["a", "b"]
    assert store.retain(u, NOW, max_units=1).first()["unit_id"] == "b"
    assert store.retain(u, NOW, max_age_ms=0, max_units=0).count() == 5
    e = {r["unit_id"]: r for r in store.enrich(u).collect()}
    assert "e" not in e and len(e["d"]["text"]) == 500 and e["d"]["fp"] != fingerprint_of("y" * 499)
    merged = store.merge_foreign(u.where("unit_id < 'c'"), u)
    assert merged.count() == 5
    rows = [("a", 0.5, [1, -2, 3]), ("é", 1.0, [127, 0, -127])]
    raw = store.encode_sidecar(rows)
    assert store.decode_sidecar(raw) == rows and store.decode_sidecar(raw[:-2]) == rows[:1] and store.decode_sidecar(b"other") == []
    (tmp_path / "x.bin").write_bytes(raw)
    assert {(r["unit_id"], tuple(r["q"])) for r in store.read_sidecars(spark, str(tmp_path)).collect()} == {("a", (1, -2, 3)), ("é", (127, 0, -127))}


def fingerprint_of(text):
    h = 5381
    for c in text:
        h = ((h * 33) % 2**32) ^ ord(c)
    return np.base_repr(h, 36).lower()


def test_answers(spark):
    a = spark.createDataFrame(
        [("1", "```x", "q", "text"), ("2", '```json\n{"a": 1}\n```', "q", "json"), ("3", "no json", "q", "json"), ("4", "about nothing", "see foo_bar", "text"), ("5", "foo_bar: THE LONG EVIDENCE LINE IS HERE, ok", "see foo_bar", "text")],
        "answer_id string, response string, query string, expects string",
    )
    hits = spark.createDataFrame([("5", "u", "the long  evidence line is here, ok")], "answer_id string, unit_id string, text string")
    got = {r["answer_id"]: r for r in calibrate(a, hits).collect()}
    assert [got[i]["ok"] for i in "12345"] == [False, True, False, False, False]
    assert got["2"]["json_parses"] and got["5"]["verbatim"] and got["4"]["entity_coverage"] == 0
    h = spark.createDataFrame([("q", 2, "b", NOW - 5_000, None, "lexical"), ("q", 1, "# a", NOW - 60_000, "S", "graph")], "query_id string, rank int, text string, ts long, session_name string, reason string")
    block = evidence_block(h, NOW, 50).first()["block"].split("\n")
    assert block[1:] == ['- [1m ago • "S" • graph] a', "- [5s ago • lexical] b"]


def test_metrics(spark):
    df = spark.createDataFrame([("the cat sat", "a cat sat down"), ("x", None), ("y y", "y z"), ("same", "Same!")], "pred string, gold string")
    f1, em, bleu = evaluation.answer_scores(F.col("pred"), F.col("gold"))
    got = [(round(r[0], 4), r[1], round(r[2], 4)) for r in df.select(f1, em, bleu).collect()]
    assert got == [(0.8, 0, 1.0), (0.0, 0, 0.0), (0.5, 0, 1.0), (1.0, 1, 1.0)]
    pairs = spark.createDataFrame([(i, 1, 0) for i in range(31)] + [(100 + i, 0, 1) for i in range(9)] + [(200, 1, 1)], "i int, x int, y int")
    m = evaluation.mcnemar(pairs).first()
    assert (m["b"], m["c"]) == (31, 9) and m["p_normal"] == pytest.approx(0.0009, abs=1e-4) and m["p_exact"] == pytest.approx(0.00068, abs=1e-5)
    p = evaluation.permutation_test(pairs, "i", draws=2_000).first()
    assert p["mean_diff"] == pytest.approx(22 / 41) and p["p"] < 0.01
    ranks = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "query_id string, rank int")
    r = evaluation.recall_mrr(ranks).first()
    assert (round(r["r1"], 3), round(r["r5"], 3), round(r["mrr"], 4)) == (0.333, 0.667, round((1 + 0.25) / 3, 4))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"u{i}", "s", None, "p", "User", f"hello number {i}", NOW + i, i, None) for i in range(20)]
    df = spark.createDataFrame(rows + rows[:5], "unit_id string, session_id string, session_name string, cwd string, role string, text string, ts_ms long, seq long, stored_at timestamp")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    from spoor.streaming.ingest import ingest_once

    got = {(r["unit_id"], r["fp"]) for r in ingest_once(spark, str(tmp_path / "in")).collect()}
    assert got == {(r["unit_id"], r["fp"]) for r in captured(spark.read.parquet(str(tmp_path / "in"))).collect()} and len(got) == 20


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bm25_topk", "unit_enrich", "entity_extract", "retrieve_ranked", "unit_edges", "answer_f1", "session_adjacent", "fused_scores"])
def test_query_equals_its_sql(spark, name):
    import os

    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    want = con.execute(catalog.ORACLE[name]).df()
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert order(want).equals(order(got))


def test_best_units_are_found_without_pairs_of_query_and_unit(spark):
    """As the scores of all pairs, ties by id, however the units lie; units without a word of a query are none."""
    rows = [(f"u{i:03d}", " ".join(f"word{j}" for j in range(12) if (i * (j + 3)) % 7 < 2) + (" other" if i % 2 else "")) for i in range(300)] + [("v", None)]
    units = spark.createDataFrame(rows, "unit_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", f"word{i} word{(5 * i) % 12} word{i} absent") for i in range(12)] + [("none", "absent"), ("blank", "")], "query_id string, text string")
    terms = lexical.query_terms(asked)
    all_pairs = lexical.bm25(terms, lexical.bm25_index(units, terms)).withColumn("bm", F.round("bm", 6))
    want = {tuple(r) for r in top_k(all_pairs, 4, F.desc("bm"), "unit_id").select("query_id", "unit_id", "rank", "bm").collect()}
    for parts in (1, 5):
        found = lexical.bm25_topk(terms, units.repartition(parts), 4)
        assert {tuple(r) for r in found.select("query_id", "unit_id", "rank", "bm").collect()} == want and len(want) == 48
    assert lexical.bm25_topk(terms.limit(0), units, 4).count() == lexical.bm25_topk(terms, units.limit(0), 4).count() == 0


def test_evidence_block_makes_no_pair_of_query_and_unit(spark, tmp_path, monkeypatch):
    from spoor.plans import queries_text

    rows = [(f"u{i:02d}", "s", f"name{i}", "p", "user", f"alpha beta{i % 7}", 1_700_000_000_000, None, i) for i in range(60)]
    spark.createDataFrame(rows, "unit_id string, session_id string, session_name string, cwd string, role string, text string, ts_ms long, entities array<string>, seq long").write.parquet(f"{tmp_path}/trace_units.parquet")
    spark.createDataFrame([("f1", "x", ["alpha beta3"]), ("f2", "x", ["gamma"])], "id string, text string, queries array<string>").write.parquet(f"{tmp_path}/eval_facts.parquet")

    def pairs(*_):
        raise AssertionError("all pairs are made")

    monkeypatch.setattr(queries_text, "bm25", pairs)
    (found,) = queries_text.evidence_blocks(spark, str(tmp_path)).collect()
    lines = found["block"].split("\n")[1:]
    assert found["query_id"] == "f1:1" and [x.split('"')[1] for x in lines] == ["name3", "name10", "name17"]


def test_ppr_pushed_in_memory_equals_the_joined_steps(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"u{i:02d}", f"e{e}") for i in range(60) for e in {int(x) for x in rng.integers(0, 25, 3)}] + [("alone", "only")]
    postings = spark.createDataFrame(rows, "unit_id string, entity string")
    weights = graph.entity_weights(postings, spark.createDataFrame([(61,)], "n_units long"))
    # two queries with the same seeds, one whose seed has no edges, one of a seed that is in no posting
    seeds = [("a", "u01", 2.0), ("a", "u05", 1.0), ("b", "u05", 1.0), ("b", "u01", 2.0), ("c", "u07", 1.0), ("c", "alone", 3.0), ("d", "gone", 1.0)]
    seeds = spark.createDataFrame(seeds, "query_id string, unit_id string, seed double")
    kept, names = graph.materialize, []
    monkeypatch.setattr(graph, "materialize", lambda d, name: (names.append(name), kept(d, name))[1])
    got = {(r["query_id"], r["unit_id"]): r["mass"] for r in graph.ppr(seeds, postings, weights, least=0.004).collect()}
    assert "ppr-moving" not in names
    monkeypatch.setattr(graph, "WHOLE", 0)
    want = {(r["query_id"], r["unit_id"]): r["mass"] for r in graph.ppr(seeds, postings, weights, least=0.004).collect()}
    assert "ppr-moving" in names and set(got) == set(want) and len(want) > 60
    assert all(abs(want[k] - got[k]) < 1e-12 for k in want) and got["d", "gone"] == 1.0


def test_pairs_of_units_are_made_once(spark, monkeypatch):
    """As by brute force, with a hub in several parts; no pair goes through an exchange."""
    monkeypatch.setattr(graph, "SPLIT", 7)
    rng = np.random.default_rng(9)
    sets = {f"u{i:02d}": {"hub"} | {f"e{x}" for x in rng.integers(0, 9, 3)} for i in range(40)} | {"v": {"own"}, "w": {"e1"}}
    postings = spark.createDataFrame([(u, e) for u, es in sets.items() for e in es], "unit_id string, entity string")
    seeds = spark.createDataFrame([("u03",), ("w",), ("v",), ("w",)], "unit_id string")
    found = graph.neighbours(seeds, postings)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted((s, u) for s in ("u03", "w", "v") for u in sets if u != s and sets[s] & sets[u])
    weight = {e: 1.0 + k / 7 for k, e in enumerate(sorted(set().union(*sets.values()) - {"e4"}))}
    n = {e: sum(e in es for es in sets.values()) for e in weight}
    weights = spark.createDataFrame([(e, n[e], w) for e, w in weight.items()], "entity string, n long, w double")
    linked = graph.edges(postings, weights)
    got = {(r["src"], r["dst"]): r["w"] for r in linked.collect()}
    want = {(a, b): sum(weight[e] for e in sets[a] & sets[b] & set(weight)) for a in sets for b in sets if a != b and sets[a] & sets[b] & set(weight)}
    assert set(got) == set(want) and linked.count() == len(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for df in (found, linked):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan.split("Join")[0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_listed_without_a_join(spark, monkeypatch):
    """Neither units of an entity nor pairs are copied into shuffle files; the joined form gives the same rows."""
    rng = np.random.default_rng(3)
    postings = spark.createDataFrame(sorted({(f"u{rng.integers(60)}", f"e{rng.integers(12)}") for _ in range(150)}), "unit_id string, entity string").cache()
    seeds = spark.createDataFrame([("u1",), ("u2",), ("u2",), ("nowhere",)], "unit_id string")
    for few in (seeds, postings.select("unit_id")):
        found = graph.neighbours(few, postings)
        assert "Join" not in _plan(found)
        rows = found.collect()
        with monkeypatch.context() as m:
            m.setattr(graph, "WHOLE", 0)
            assert sorted(rows) == sorted(graph.neighbours(few, postings).collect()) and rows
    assert graph.neighbours(seeds, postings.limit(0)).count() == 0


def test_ppr_of_entities_writes_no_seed(spark, monkeypatch):
    """Seeds made in the tasks, of hubs and of units without edges too, give what seeds of ``entity_hits`` give."""
    rng = np.random.default_rng(4)
    rows = [(f"u{i:02d}", f"e{e}") for i in range(60) for e in {int(x) for x in rng.integers(0, 25, 3)}] + [(f"u{i:02d}", "hub") for i in range(30)] + [("alone", "only"), ("other", "hub")]
    postings = spark.createDataFrame(rows, "unit_id string, entity string").cache()
    weights = graph.entity_weights(postings, spark.createDataFrame([(62,)], "n_units long"))
    asked = [("a", "e1"), ("a", "hub"), ("b", "hub"), ("b", "e1"), ("c", "only"), ("c", "e7"), ("d", "nowhere"), ("e", "hub")]
    asked = spark.createDataFrame(asked, "query_id string, entity string")
    kept, names = graph.materialize, []
    monkeypatch.setattr(graph, "materialize", lambda d, name: (names.append(name), kept(d, name))[1])
    got = {(r["query_id"], r["unit_id"]): r["mass"] for r in graph.ppr_of_entities(asked, postings, weights, least=0.004).collect()}
    assert "ppr-seeds" not in names
    want = {(r["query_id"], r["unit_id"]): r["mass"] for r in graph.ppr(graph.entity_hits(asked, postings).withColumn("seed", F.col("hits").cast("double")), postings, weights, least=0.004).collect()}
    assert "ppr-seeds" in names and set(got) == set(want) and {q for q, _ in got} == set("abce")
    assert all(abs(want[k] - got[k]) < 1e-12 for k in want) and got["c", "alone"] > 0
    assert graph.ppr_of_entities(asked, postings.limit(0), weights).count() == 0


def test_edges_are_made_without_a_join(spark):
    """Weights of shared entities are added in the tasks, rounded once; pairs neither meet nor add up in the plan."""
    rows = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "z"), ("d", "left out"), ("a", "left out")]
    postings = spark.createDataFrame(rows, "unit_id string, entity string")
    weights = spark.createDataFrame([("x", 2, 0.1234567), ("y", 3, 1.0), ("z", 1, 2.0)], "entity string, n long, w double")
    linked = graph.edges(postings, weights, 6)
    assert "Join" not in _plan(linked)
    want = {("a", "b"): 1.123457, ("a", "c"): 1.0, ("b", "c"): 1.0}
    assert {tuple(r) for r in linked.collect()} == {(s, d, w) for (a, b), w in want.items() for s, d in ((a, b), (b, a))}
