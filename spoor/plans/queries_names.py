"""Registered queries of names, prompts and samples, over literal frames where no test table tells a name."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.functions import text as T
from spoor.operators import identity as I
from spoor.operators.answers import calibrate
from spoor.operators.prompt import compose, recall
from spoor.operators.retrieval import Options
from spoor.plans.registry import register
from spoor.runtime import load

NOW = 1_743_500_000_000
#: Units that name someone, or seem to: id, role, text; a minute apart, ending an hour before NOW.
TOLD = (
    ("n01", "user", "call me back later"),
    ("n02", "user", "Call me Ada, please"),
    ("n03", "assistant", "I am going to look. My name is Orrin"),
    ("n04", "assistant", "I'm Claude"),
    ("n05", "user", "your name is Quill from now on"),
    ("n06", "user", "let's go with 'Ferro' then"),
    ("n07", "assistant", "you're Nadia, right?"),
    ("n08", "user", "the time of the simple image is over"),
    ("n09", "assistant", "I don't have a personal name"),
    ("n10", "user", "my name is Berit"),
    ("n11", "tool", "my name is Toolish"),
    ("n12", "assistant", "known as Vesper"),
)
_VALUES = ", ".join("('{}', '{}', '{}', {}::BIGINT, {}::BIGINT)".format(u, r, t.replace("'", "''"), NOW - 3_600_000 - (len(TOLD) - i) * 60_000, i) for i, (u, r, t) in enumerate(TOLD))
_TOLD = f"t AS (SELECT * FROM (VALUES {_VALUES}) v(unit_id, role, text, ts, seq))"
_NOT = "[" + ", ".join(f"'{w}'" for w in sorted(I.NOT_NAMES)) + "]"
_DEFAULT = "[" + ", ".join(f"'{w}'" for w in sorted(I.DEFAULT_NAMES)) + "]"
_PATTERN = I._NAMING.pattern.replace("'", "''")
# the first naming phrase that a possible name follows
_EVENTS = f"""ev AS (SELECT *, regexp_extract_all(text, '(?i){_PATTERN}', 1) AS g, regexp_extract_all(text, '(?i){_PATTERN}', 0) AS w FROM t),
ne AS (SELECT *, list_position(list_transform(g, lambda x: coalesce(x, '') <> '' AND NOT list_contains({_NOT}, lower(x))), true) AS i FROM ev),
nm AS (SELECT *, lower(g[i]) AS name, strpos(text, w[i]) - 1 AS pos, list_contains({_DEFAULT}, lower(g[i])) AS default_name FROM ne)"""


def told(spark):
    rows = [(u, r, t, NOW - 3_600_000 - (len(TOLD) - i) * 60_000, i, "p", "s1", None) for i, (u, r, t) in enumerate(TOLD)]
    return spark.createDataFrame(rows, "unit_id string, role string, text string, ts long, seq long, cwd string, session_id string, session_name string")


@register("naming_told", f"WITH {_TOLD}, {_EVENTS} SELECT unit_id, pos::INT AS pos, name, default_name FROM nm WHERE i > 0")
def naming_told(spark, sf_dir):
    """Who names whom, in the literal frame."""
    return told(spark).select("unit_id", I.naming_match("text").alias("n")).where("n.name is not null").select("unit_id", "n.pos", "n.name", "n.default_name")


@register(
    "identity_told",
    "SELECT 'vesper' AS agent_name, 'self-named' AS agent_source, 'berit' AS user_name, 'user-stated' AS user_source, "
    "'- Identity: the assistant''s name is \"vesper\" (self-named 1h ago) — use this name when asked; the user''s name is \"berit\"' AS line",
)
def identity_told(spark, sf_dir):
    """The newest names of the literal frame and the line that tells them; the SQL states what a reader finds in it."""
    names = I.identity_facts(told(spark))
    line = I.identity_line(T.rel_time(F.col("agent_name_ts"), F.lit(NOW)))
    return names.select("agent_name", "agent_source", "user_name", "user_source", line.alias("line"))


@register(
    "perspective_told",
    f"""WITH {_TOLD}, {_EVENTS}, a AS (SELECT unit_id, role, name, pos, default_name, lower(text) AS l,
  regexp_matches(lower(text), '\\b(don''?t|do not|doesn''?t) have (a |any )?(personal |custom )?name\\b') AS denies FROM nm)
SELECT unit_id, round(CASE WHEN role = 'user' AND regexp_matches(l, '\\byour name is\\b') THEN 1.0 WHEN role = 'assistant' AND name IS NOT NULL AND NOT denies AND default_name THEN -0.5
  WHEN role = 'assistant' AND name IS NOT NULL AND NOT denies THEN greatest(0.2, 1 - pos / 600.0) ELSE -1.0 END, 6)::DOUBLE AS you FROM a""".replace("\\\\", "\\"),
)
def perspective_told(spark, sf_dir):
    """How well each unit of the literal frame answers a question for the assistant's name."""
    u = told(spark).withColumn("n", I.naming_match("text"))
    return u.select("unit_id", F.round(I.perspective(F.lit("you"), F.col("role"), F.col("text"), F.col("n")), 6).alias("you"))


_ASKED = (("q1", "what is your name?", True), ("q2", "where is the simple image", False), ("q3", "zzz yyy", False), ("q4", "zzz yyy", True))


def _asked(spark):
    return spark.createDataFrame([(q, t, "p", "s2", NOW, f) for q, t, f in _ASKED], "query_id string, text string, cwd string, session_id string, now long, first_turn boolean")


@register("prompt_blocks", "SELECT * FROM (VALUES ('q1', true, true), ('q2', false, true), ('q4', true, false)) v(query_id, tells_names, has_hits)")
def prompt_blocks(spark, sf_dir):
    """Which composed prompts of the literal frame tell the names, and which hold evidence; the SQL states what must come out."""
    blocks = compose(_asked(spark), told(spark).withColumn("ents", T.entities(F.col("text"))), NOW, Options(use_bridges=False))
    return blocks.select("query_id", F.contains("block", F.lit("- Identity: ")).alias("tells_names"), (F.col("hits") > 0).alias("has_hits"))


@register("recall_text", "SELECT * FROM (VALUES ('q1', false), ('q2', false), ('q3', true), ('q4', true)) v(query_id, nothing)")
def recall_text(spark, sf_dir):
    """Which recalls of the literal frame find nothing."""
    found = recall(_asked(spark), told(spark).withColumn("ents", T.entities(F.col("text"))), NOW, Options(use_bridges=False, top_k=8))
    return found.select("query_id", ((F.col("hits") == 0) & (F.col("text") == "No matching memory.")).alias("nothing"))


_CHECKED = (("a1", "uses `pool_size` here", "what of pool_size and max_wait?", "text"), ("a2", "nothing of that", "what of pool_size?", "text"), ("a3", '{"a": 1}', "", "json"), ("a4", "{a: ", "", "json"), ("a5", "```py\nx", "", "text"))


@register(
    "answers_checked",
    "SELECT * FROM (VALUES ('a1', true, 0.5::DOUBLE, NULL::BOOLEAN), ('a2', false, 0.0, NULL), ('a3', true, 1.0, true), ('a4', false, 1.0, false), ('a5', false, 1.0, NULL)) v(answer_id, ok, entity_coverage, json_parses)",
)
def answers_checked(spark, sf_dir):
    """Fences, JSON and entities of literal answers; the SQL states what must come out."""
    frame = spark.createDataFrame(list(_CHECKED), "answer_id string, response string, query string, expects string")
    return calibrate(frame).select("answer_id", "ok", "entity_coverage", "json_parses")


@register("seeded_sample", "SELECT i, ablation FROM (SELECT DISTINCT i, ablation, md5(i || ':' || coalesce(ablation, '') || ':7') AS h FROM reader_rows) ORDER BY h LIMIT 50")
def seeded_sample(spark, sf_dir):
    """Fifty rows drawn by a seeded hash, the same on every run and whatever the partitions."""
    rows = load(spark, sf_dir, "reader_rows").select("i", "ablation").distinct()
    return rows.orderBy(F.md5(F.concat_ws(":", F.col("i").cast("string"), F.coalesce("ablation", F.lit("")), F.lit("7")))).limit(50)
