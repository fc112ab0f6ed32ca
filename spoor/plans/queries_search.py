"""Registered queries: vectors, graph, fusion, the retrieval pipeline, identity, evaluation."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions import text as T
from spoor.functions.vectors import cosine, dequantize, jaccard, quantize
from spoor.operators.evaluation import answer_scores, mcnemar, paired, permutation_test, recall_mrr
from spoor.operators.graph import LEAST, edges, entity_hits, entity_weights, neighbours, ppr_of_entities, unit_entities
from spoor.operators.identity import asks_about, identity_facts, identity_line, naming_match, perspective, sticky_identity
from spoor.operators.lexical import bm25, bm25_index, coverage, query_terms
from spoor.operators.ranking import top_k
from spoor.operators.retrieval import Options, fused, retrieve
from spoor.operators.vector import CellIndex, exact_topk, extremes, similarities
from spoor.plans import sql as S
from spoor.plans.queries_text import NOW_MS, PROJECT, fact_queries, fact_units
from spoor.plans.registry import register
from spoor.runtime import load, materialize, spread
from spoor.sources.units import units
from spoor.streaming.ingest import ingest_once

# --- vectors -----------------------------------------------------------------------


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("unit_id"), "embedding", "label")


def _asked(spark, sf_dir):
    """The vectors whose id is divisible by 20, as queries."""
    asked = load(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return asked.select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("qvec"))


@register(
    "cosine_topk",
    f"WITH s AS (SELECT a.vec_id::VARCHAR AS query_id, b.vec_id::VARCHAR AS unit_id, round({S.cosine('a.embedding', 'b.embedding')}, 9) AS c FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, unit_id)::INT AS rank FROM s) SELECT query_id, unit_id, rank, round(c, 5) AS cosine FROM r WHERE rank <= 5",
)
def cosine_topk(spark, sf_dir):
    return exact_topk(_asked(spark, sf_dir), _vectors(spark, sf_dir), 5).withColumn("cosine", F.round("cosine", 5))


@register("ann_recall", "SELECT TRUE AS met")
def ann_recall(spark, sf_dir):
    """Whether recall at 10 of the inverted file against exact search is 0.85 or more."""
    asked, vectors = _asked(spark, sf_dir), _vectors(spark, sf_dir)
    exact = exact_topk(asked, vectors, 10).select("query_id", "unit_id")
    near = CellIndex(vectors).topk(asked, 10).select("query_id", "unit_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "unit_id"], "left").agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.85).alias("met"))


_Q8 = "list_transform(v, lambda x: floor(x / s * 127 + 0.5))"


@register(
    "int8_drift",
    "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT *, greatest(list_max(v), -list_min(v)) AS s FROM e) "
    f"SELECT vec_id, round(1 - {S.cosine('v', _Q8)}, 6) + 0.0 AS drift FROM t",
)
def int8_drift(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("c", quantize(F.col("v")))
    return e.select("vec_id", F.round(1 - cosine(F.col("v"), dequantize(F.col("c.scale").cast("double"), F.col("c.q"))), 6).alias("drift"))


@register(
    "sidecar_vectors",
    f"WITH {S.UNITS}, n AS (SELECT unit_id, q::DOUBLE[] AS q, embedding::DOUBLE[] AS v FROM unit_sidecar JOIN u USING (unit_id) WHERE len(embedding) = len(q)) "
    f"SELECT unit_id, round({S.cosine('q', 'v')}, 5) AS cosine FROM n WHERE list_aggregate(list_transform(q, lambda x: abs(x)), 'sum') > 0 AND list_aggregate(list_transform(v, lambda x: abs(x)), 'sum') > 0",
)
def sidecar_vectors(spark, sf_dir):
    """Vectors restored from the sidecar against the stored ones."""
    s = load(spark, sf_dir, "unit_sidecar").select("unit_id", dequantize(F.col("scale").cast("double"), F.col("q")).alias("r"))
    u = units(spark, sf_dir, "embedding").select("unit_id", "embedding")
    both = s.join(u, "unit_id").where(F.size("r") == F.size("embedding"))
    some = F.exists("r", lambda x: x != 0) & F.exists("embedding", lambda x: x != 0)
    return both.where(some).select("unit_id", F.round(cosine(F.col("r"), F.col("embedding")), 5).alias("cosine"))


@register(
    "jaccard_pairs",
    f"WITH t AS (SELECT id, list_distinct({S.tokens('text')}) AS t FROM eval_facts), x AS (SELECT id, unnest(t) AS term FROM t), "
    "p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM x a JOIN x b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2) "
    "SELECT id_a, id_b, round(n / (len(a.t) + len(b.t) - n)::DOUBLE, 6) AS jaccard FROM p JOIN t a ON a.id = id_a JOIN t b ON b.id = id_b WHERE n >= 0.15 * (len(a.t) + len(b.t) - n)",
)
def jaccard_pairs(spark, sf_dir):
    t = load(spark, sf_dir, "eval_facts").select("id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    x = t.select("id", F.explode("t").alias("term"), F.size("t").alias("n"))
    met = x.alias("a").join(x.alias("b"), (F.col("a.term") == F.col("b.term")) & (F.col("a.id") < F.col("b.id")))
    both = met.groupBy(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count("*").alias("n"))
    union = F.col("na") + F.col("nb") - F.col("n")
    return both.where(F.col("n") >= 0.15 * union).select("id_a", "id_b", F.round(F.col("n") / union, 6).alias("jaccard"))


@register("label_spread", "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), "
    "s AS (SELECT label, i, sum(x) AS s, sum(x * x) AS d FROM e GROUP BY 1, 2) SELECT label, any_value(n) AS n, round((sum(s * s) - sum(d)) / (any_value(n) * (any_value(n) - 1)), 5) AS mean_similarity FROM s JOIN n USING (label) GROUP BY 1 HAVING any_value(n) > 1")
def label_spread(spark, sf_dir):
    """Mean pairwise similarity of unit vectors within a label, from their sum: no pair is made."""
    e = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    s = e.groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x")).alias("d"), F.count("*").alias("n"))
    total = s.groupBy("label").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("d").alias("dd")).where("n > 1")
    return total.select("label", "n", F.round((F.col("ss") - F.col("dd")) / (F.col("n") * (F.col("n") - 1)), 5).alias("mean_similarity"))


# --- graph --------------------------------------------------------------------------

_DOCS = f"f AS (SELECT doc_id::VARCHAR AS unit_id, {S.entities('text')} AS l FROM documents), ue AS (SELECT unit_id, unnest({S.first_distinct('l', 16)}) AS entity FROM f), nn AS (SELECT count(*) AS n_units FROM documents)"
_WEIGHTS = "we AS (SELECT entity, count(*) AS n, ln(1 + any_value(n_units) / count(*)::DOUBLE) AS w FROM ue, nn GROUP BY 1 HAVING count(*) <= greatest(20, floor(0.1 * any_value(n_units))))"
_EDGES = "ed AS (SELECT a.unit_id AS src, b.unit_id AS dst, sum(w) AS w FROM ue a JOIN we USING (entity) JOIN ue b USING (entity) WHERE a.unit_id <> b.unit_id GROUP BY 1, 2)"


def _graph(spark, sf_dir):
    """The entity graph of the documents: units, postings, weights."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("unit_id"), T.entities(F.col("text")).alias("ents"))
    docs = materialize(docs, "graph-docs")
    postings = unit_entities(docs)
    return docs, postings, entity_weights(postings, docs.agg(F.count("*").alias("n_units")))


@register("unit_edges", f"WITH {_DOCS}, {_WEIGHTS}, {_EDGES} SELECT src, dst, round(w, 6) AS w FROM ed")
def unit_edges(spark, sf_dir):
    _, postings, weights = _graph(spark, sf_dir)
    return edges(postings, weights, 6)


@register("entity_weights", f"WITH {S.UNITS}, {S.POSTINGS}, nn AS (SELECT count(*) AS n_units FROM u), {_WEIGHTS} SELECT entity, n, round(w, 6) AS w FROM we")
def weights_of_entities(spark, sf_dir):
    u = units(spark, sf_dir)
    return entity_weights(unit_entities(u), u.agg(F.count("*").alias("n_units"))).withColumn("w", F.round("w", 6))


@register(
    "unit_strength",
    f"WITH {S.UNITS}, {S.POSTINGS}, nn AS (SELECT count(*) AS n_units FROM u), {_WEIGHTS} SELECT unit_id, round(sum(w * (n - 1)), 5) AS strength FROM ue JOIN we USING (entity) GROUP BY 1",
)
def unit_strength(spark, sf_dir):
    """The summed weight of each unit's edges, without making an edge."""
    u = units(spark, sf_dir)
    postings = unit_entities(u)
    held = postings.join(entity_weights(postings, u.agg(F.count("*").alias("n_units"))), "entity")
    return held.groupBy("unit_id").agg(F.round(F.sum(F.col("w") * (F.col("n") - 1)), 5).alias("strength"))


@register("entity_cooc", f"WITH {_DOCS} SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS n FROM ue a JOIN ue b ON a.unit_id = b.unit_id AND a.entity < b.entity GROUP BY 1, 2")
def entity_cooc(spark, sf_dir):
    _, p, _ = _graph(spark, sf_dir)
    met = p.alias("a").join(p.alias("b"), (F.col("a.unit_id") == F.col("b.unit_id")) & (F.col("a.entity") < F.col("b.entity")))
    return met.groupBy(F.col("a.entity").alias("entity_a"), F.col("b.entity").alias("entity_b")).agg(F.count("*").alias("n"))


@register("graph_neighbors", f"WITH {_DOCS} SELECT DISTINCT a.unit_id AS seed_id, b.unit_id FROM ue a JOIN ue b USING (entity) WHERE a.unit_id <> b.unit_id")
def graph_neighbors(spark, sf_dir):
    docs, postings, _ = _graph(spark, sf_dir)
    return neighbours(docs, postings)


_FQE = f"fe AS (SELECT query_id, {S.entities('text')} AS l FROM fq), qe AS (SELECT query_id, unnest({S.first_distinct('l', 16)}) AS entity FROM fe)"
_HITS = "hits AS (SELECT query_id, unit_id, count(*) AS hits FROM qe JOIN ue USING (entity) GROUP BY 1, 2)"


@register("entity_hits", f"WITH {_DOCS}, {S.FACT_QUERIES}, {_FQE}, {_HITS} SELECT * FROM hits")
def hits_of_entities(spark, sf_dir):
    _, postings, _ = _graph(spark, sf_dir)
    q = fact_queries(spark, sf_dir).select("query_id", F.explode(T.entities(F.col("text"))).alias("entity"))
    return entity_hits(q, postings)


def _ppr_sql(steps: int = 24, gamma: float = 0.6) -> str:
    parts = [
        f"WITH {_DOCS}, {S.FACT_QUERIES}, {_FQE}, {_HITS}, {_WEIGHTS}, {_EDGES}",
        "rw AS (SELECT src, sum(w) AS r FROM ed GROUP BY 1)",
        "p0 AS MATERIALIZED (SELECT query_id, unit_id, hits / sum(hits) OVER (PARTITION BY query_id)::DOUBLE AS m FROM hits)",
    ]
    for i in range(1, steps + 1):
        parts.append(
            f"p{i} AS MATERIALIZED (SELECT query_id, unit_id, sum(m) AS m FROM (SELECT query_id, dst AS unit_id, {gamma}::DOUBLE * m * w / r AS m FROM p{i - 1} JOIN ed ON src = unit_id JOIN rw USING (src) WHERE m >= {LEAST}::DOUBLE "
            f"UNION ALL SELECT query_id, unit_id, {gamma}::DOUBLE * m FROM p{i - 1} WHERE m >= {LEAST}::DOUBLE AND unit_id NOT IN (SELECT src FROM rw)) GROUP BY 1, 2)"
        )
    kept = " UNION ALL ".join(f"SELECT query_id, unit_id, CASE WHEN m >= {LEAST}::DOUBLE THEN {1 - gamma}::DOUBLE * m ELSE m END AS m FROM p{i}" for i in range(steps))
    return ", ".join(parts) + f" SELECT query_id, unit_id, round(sum(m), 12) AS mass FROM ({kept} UNION ALL SELECT query_id, unit_id, m FROM p{steps}) GROUP BY 1, 2"


@register("ppr_mass", _ppr_sql())
def ppr_mass(spark, sf_dir):
    _, postings, weights = _graph(spark, sf_dir)
    asked = fact_queries(spark, sf_dir).select("query_id", F.explode(T.entities(F.col("text"))).alias("entity"))
    return ppr_of_entities(asked, postings, weights, digits=12)


# --- fusion and retrieval ---------------------------------------------------------------


def _fact_vectors(spark, sf_dir):
    """Facts and their questions with vectors: those of the whole embeddings table, taken in turn."""
    e = load(spark, sf_dir, "embeddings")
    n = max(1, e.count())
    vectors = e.select(F.col("vec_id").alias("v"), "embedding")
    number = F.expr("cast(substring(id, 2) as bigint)")
    facts = load(spark, sf_dir, "eval_facts").select("id", (number % n).alias("v")).join(vectors, "v").select(F.col("id").alias("unit_id"), "embedding")
    return facts, fact_queries(spark, sf_dir).select("query_id", ((number * 7) % n).alias("v")).join(vectors, "v").select("query_id", F.col("embedding").alias("qvec"))


def _entity_vectors(spark, sf_dir, *texts):
    """Entities of the texts with vectors of the embeddings table, chosen by hash, as no table has vectors of entities."""
    e = load(spark, sf_dir, "embeddings")
    named = [t.select(F.explode(T.entities(F.col("text"))).alias("entity")) for t in texts]
    entities = functools.reduce(DataFrame.unionByName, named).distinct()
    return entities.withColumn("v", F.pmod(F.xxhash64("entity"), F.lit(max(1, e.count())))).join(e.select(F.col("vec_id").alias("v"), "embedding"), "v").select("entity", "embedding")


_SCORES = (
    f"ff AS (SELECT id AS unit_id, text FROM eval_facts), {S.FACT_QUERIES}, {S.bm25('ff', 'text', 'fq')}, "
    "vec AS (SELECT vec_id AS v, embedding::DOUBLE[] AS e FROM embeddings), "
    "fv AS (SELECT id AS unit_id, e FROM eval_facts JOIN vec ON v = substring(id, 2)::BIGINT % (SELECT count(*) FROM embeddings)), "
    "qv AS (SELECT query_id, e FROM fq JOIN vec ON v = substring(id, 2)::BIGINT * 7 % (SELECT count(*) FROM embeddings)), "
    f"sem AS (SELECT query_id, unit_id, (round({S.cosine('qv.e', 'fv.e')}, 9) + 1) / 2 AS sem FROM qv, fv), "
    "b AS (SELECT query_id, unit_id, coalesce(bm, 0) AS bm, sem FROM sem LEFT JOIN bm USING (query_id, unit_id)), "
    "k AS (SELECT *, min(bm) OVER w AS bl, max(bm) OVER w AS bh, min(sem) OVER w AS sl, max(sem) OVER w AS sh FROM b WINDOW w AS (PARTITION BY query_id)), "
    "n AS (SELECT *, CASE WHEN bh > bl THEN (bm - bl) / (bh - bl) WHEN bm > 0 THEN 1 ELSE 0 END AS bn, CASE WHEN sh > sl THEN (sem - sl) / (sh - sl) WHEN sem > 0 THEN 1 ELSE 0 END AS sn, "
    "least(1, bh / greatest(1.2, least(4, 1.2 + (SELECT count(*) FROM eval_facts) / 200.0::DOUBLE))) AS bc, least(1, greatest(0, (2 * sh - 1 - 0.55) / 0.25)) AS sc FROM k), "
    "x AS (SELECT query_id, unit_id, greatest(bc, sc) * (coalesce(cov, 0) * bn + (1 - coalesce(cov, 0)) * sn) AS by_coverage, greatest(bc, sc) * greatest(bn, sn) AS by_max, greatest(bc, sc) * (0.5 * bn + 0.5 * sn) AS by_weight "
    "FROM n LEFT JOIN cov USING (query_id))"
)


def _fused(spark, sf_dir, fusion: str):
    """Fused scores of a stated query set over the facts.

    Pairs are made only where a term is shared, and of the nearest facts: all others score
    by their similarity alone, so no more than the ten nearest can be among the first ten. What scores 0 is not found.
    The extremes of a query's similarities come from the scan.
    """
    facts, asked = _fact_vectors(spark, sf_dir)
    facts, asked = materialize(facts, "fact-vectors"), materialize(asked, "asked-vectors")
    n = facts.count()
    half = lambda c: (F.round(c, 9) + 1) / 2
    near = exact_topk(asked, facts, 30).select("query_id", "unit_id")
    terms = query_terms(fact_queries(spark, sf_dir))
    index = bm25_index(fact_units(spark, sf_dir), terms)
    lexical = materialize(bm25(terms, index), "fact-bm25")
    pairs = lexical.select("query_id", "unit_id").unionByName(near).distinct().join(asked, "query_id").join(facts, "unit_id")
    sem = pairs.select("query_id", "unit_id", half(cosine(F.col("qvec").cast("array<double>"), F.col("embedding").cast("array<double>"))).alias("sem"))
    range_ = extremes(asked, facts).select("query_id", half(F.col("lowest")).alias("sem_min"), half(F.col("highest")).alias("sem_max"))
    bm_range = lexical.groupBy("query_id").agg(F.when(F.count("*") >= n, F.min("bm")).otherwise(F.lit(0.0)).alias("bm_min"), F.max("bm").alias("bm_max"))
    both = sem.join(lexical, ["query_id", "unit_id"], "left").join(range_, "query_id").join(bm_range, "query_id", "left").na.fill(0.0, ["bm", "bm_min", "bm_max"])
    both = both.withColumn("bm_conf", F.least(F.lit(1.0), F.col("bm_max") / max(1.2, min(4.0, 1.2 + n / 200))))
    both = both.withColumn("sem_conf", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (2 * F.col("sem_max") - 1 - 0.55) / 0.25)))
    scored = both.join(coverage(terms, index), "query_id", "left").na.fill(0.0, ["cov"]).withColumn("score", F.round(fused(Options(fusion=fusion), True), 6)).where("score > 0")
    return top_k(scored, 10, F.desc("score"), "unit_id").select("query_id", "unit_id", "rank", "score")


for _name, _fusion, _column in (("fused_scores", "coverage", "by_coverage"), ("fusion_max", "max", "by_max"), ("fusion_weighted", "weighted", "by_weight")):
    register(
        _name,
        f"WITH {_SCORES}, r AS (SELECT query_id, unit_id, round({_column}, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({_column}, 6) DESC, unit_id)::INT AS rank FROM x WHERE round({_column}, 6) > 0) SELECT * FROM r WHERE rank <= 10",
    )(lambda spark, sf_dir, fusion=_fusion: _fused(spark, sf_dir, fusion))


def _pipeline_queries(spark, sf_dir):
    return fact_queries(spark, sf_dir).select("query_id", "text", F.lit(PROJECT).alias("cwd"), F.lit(None).cast("string").alias("session_id"), F.lit(NOW_MS).alias("now"))


_RETRIEVE = f"""WITH {S.UNITS}, {S.POSTINGS}, {S.FACT_QUERIES}, {S.bm25('u', 'text', 'fq')}, {_FQE},
uf AS (SELECT unit_id, cwd, text, seq, session_id, ts, {S.fingerprint("coalesce(text, '')")} AS fp, coalesce(cwd = '{PROJECT}', false) AS inside FROM u),
q AS (SELECT fq.query_id, text, CASE WHEN (SELECT count(*) FROM qe WHERE qe.query_id = fq.query_id) > 0 AND NOT {S.TEMPORAL} THEN 0.6::DOUBLE ELSE 0.4 END AS wg FROM fq),
g AS (SELECT query_id, unit_id, count(*)::DOUBLE AS g FROM qe JOIN ue USING (entity) GROUP BY 1, 2),
gs AS (SELECT query_id, min(g) AS gl, max(g) AS gh FROM g GROUP BY 1),
t AS (SELECT query_id, unit_id, bm, g FROM bm FULL JOIN g USING (query_id, unit_id)),
s AS (SELECT t.*, inside, seq FROM t JOIN uf USING (unit_id)),
z AS (SELECT inside, count(*) AS n FROM uf GROUP BY 1),
ps AS (SELECT query_id, inside, CASE WHEN count(bm) >= any_value(n) THEN min(bm) ELSE 0 END AS bl, coalesce(max(bm), 0) AS bh,
  least(1, coalesce(max(bm), 0) / greatest(1.2, least(4, 1.2 + (SELECT count(*) FROM u) / 200.0::DOUBLE))) AS c FROM s JOIN z USING (inside) GROUP BY 1, 2),
n AS (SELECT s.query_id, unit_id, s.inside, seq, wg, c,
  CASE WHEN bh > bl THEN (coalesce(bm, 0) - bl) / (bh - bl) WHEN coalesce(bm, 0) > 0 THEN 1 ELSE 0 END * c AS h,
  CASE WHEN gh IS NULL THEN 0 WHEN gh > gl THEN (coalesce(g, 0) - gl) / (gh - gl) WHEN coalesce(g, 0) > 0 THEN 1 ELSE 0 END AS gn
  FROM s JOIN q USING (query_id) JOIN ps ON ps.query_id = s.query_id AND ps.inside = s.inside LEFT JOIN gs ON gs.query_id = s.query_id),
sc AS (SELECT *, CASE WHEN inside THEN 1 ELSE 0.7::DOUBLE END * (wg * gn * c + (1 - wg) * h) AS score,
  CASE WHEN gn > 0 AND h > 0 THEN 'graph+lexical' WHEN gn > 0 THEN 'graph' ELSE 'lexical' END || CASE WHEN inside THEN '' ELSE '+cross-project' END AS reason FROM n),
be AS (SELECT query_id, coalesce(max(score) FILTER (WHERE inside), 0) AS bi, coalesce(max(score) FILTER (WHERE NOT inside), 0) AS bo FROM sc WHERE score > 0 GROUP BY 1),
sd AS (SELECT query_id, unit_id, score, reason, seq, row_number() OVER (PARTITION BY query_id ORDER BY NOT inside, seq, unit_id) AS ord FROM sc JOIN be USING (query_id)
  WHERE score > 0.15 AND (inside OR (bi <= 0.45 AND (bi <= 0.15 OR bo > bi + 0.15)))),
fe1 AS (SELECT query_id, entity, min(ord) AS ord FROM sd JOIN ue USING (unit_id) GROUP BY 1, 2),
sh AS (SELECT query_id, unit_id, min(ord) AS ord, 0 AS kind FROM fe1 JOIN ue USING (entity) GROUP BY 1, 2),
ad AS (SELECT unit_id, lag(unit_id) OVER w AS p, lead(unit_id) OVER w AS x FROM u WHERE session_id IS NOT NULL AND session_id <> 'unknown'
  WINDOW w AS (PARTITION BY session_id ORDER BY ts NULLS FIRST, seq NULLS FIRST, unit_id)),
cl AS (SELECT query_id, unit_id, min((ord, kind)) AS ok FROM (SELECT * FROM sh UNION ALL SELECT query_id, p, ord, 1 FROM sd JOIN ad USING (unit_id) WHERE p IS NOT NULL
  UNION ALL SELECT query_id, x, ord, 2 FROM sd JOIN ad USING (unit_id) WHERE x IS NOT NULL) GROUP BY 1, 2),
al AS (SELECT query_id, unit_id, score, reason, -1 AS kind, ord, seq FROM sd UNION ALL
  SELECT cl.query_id, cl.unit_id, sd.score * CASE WHEN ok[2] > 0 THEN 0.25::DOUBLE ELSE 0.35 END, CASE WHEN ok[2] > 0 THEN 'closure:adjacent-turn' ELSE 'closure:shared-entity' END, ok[2], ok[1], uf.seq
  FROM cl JOIN sd ON sd.query_id = cl.query_id AND sd.ord = ok[1] JOIN uf ON uf.unit_id = cl.unit_id
  WHERE inside AND NOT EXISTS (SELECT 1 FROM sd d WHERE d.query_id = cl.query_id AND d.unit_id = cl.unit_id)),
rk AS (SELECT al.*, round(al.score, 9) AS rs, fp, uf.text AS ut, q.text AS qt FROM al JOIN uf USING (unit_id) JOIN q USING (query_id) WHERE al.score > 0.15),
dd AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY query_id, fp ORDER BY rs DESC, kind >= 0, ord, kind, seq, unit_id) = 1),
cp AS (SELECT *, {S.compat('qt', "coalesce(ut, '')")} AS compat FROM dd),
fi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, compat DESC, kind >= 0, ord, kind, seq, unit_id)::INT AS rank FROM cp)
SELECT query_id, rank, unit_id, round(rs, 6) AS score, reason, compat FROM fi WHERE rank <= 5"""


@register("retrieve_ranked", _RETRIEVE)
def retrieve_ranked(spark, sf_dir):
    """The pipeline with direct graph matches and without diversity."""
    found = retrieve(_pipeline_queries(spark, sf_dir), units(spark, sf_dir), Options(use_mmr=False, use_bridges=False))
    return found.withColumn("score", F.round("score", 6))


@register("retrieve_full")
def retrieve_full(spark, sf_dir):
    """The whole pipeline over the facts: lexical, dense and PageRank scores, closure, diversity."""
    facts, asked = _fact_vectors(spark, sf_dir)
    # every similarity, as the least of a pool enters its scale; a plan only, as the vectors let the tasks make them
    dense = similarities(asked, facts).select("query_id", "unit_id", ((F.col("cosine") + 1) / 2).alias("sem"))
    number = F.expr("cast(substring(id, 2) as bigint)")
    as_units = load(spark, sf_dir, "eval_facts").select(
        F.col("id").alias("unit_id"),
        F.concat(F.lit("s"), F.floor(number / 20).cast("string")).alias("session_id"),
        F.concat(F.lit("p"), (number % 3).cast("string")).alias("cwd"),
        F.when(number % 2 == 0, "user").otherwise("assistant").alias("role"),
        "text",
        (F.lit(NOW_MS - 86_400_000) + number * 60_000).alias("ts"),
        number.alias("seq"),
        T.entities(F.col("text")).alias("ents"),
    )
    asked_in = fact_queries(spark, sf_dir).select("query_id", "text", F.lit("p1").alias("cwd"), F.lit(None).cast("string").alias("session_id"), F.lit(NOW_MS).alias("now"))
    found = retrieve(asked_in, as_units.join(facts, "unit_id", "left"), Options(), dense=dense, asked_vectors=asked, entity_vectors=_entity_vectors(spark, sf_dir, as_units, asked_in))
    return found.withColumn("score", F.round("score", 6))


# --- identity -----------------------------------------------------------------------------


@register("naming_events")
def naming_events(spark, sf_dir):
    """Units that name someone, with place and name."""
    u = units(spark, sf_dir).where("text is not null").select("unit_id", naming_match("text").alias("n"))
    return u.where("n.name is not null").select("unit_id", "n.pos", "n.name", "n.default_name")


@register("identity_slots")
def identity_slots(spark, sf_dir):
    """The newest names, saved ones where nothing is told, and the line that tells them."""
    fresh = identity_facts(units(spark, sf_dir).where("text is not null"))
    saved = fresh.select(*(F.lit(None).cast(t).alias(c) for c, t in fresh.dtypes))
    both = sticky_identity(fresh, saved)
    return both.withColumn("line", identity_line(T.rel_time(F.col("agent_name_ts"), F.lit(NOW_MS))))


@register("perspective_scores")
def perspective_scores(spark, sf_dir):
    """How well units that speak of names answer two questions about them."""
    asked = spark.createDataFrame([("agent", "what is your name?"), ("user", "what is my name?")], "query_id string, q string")
    u = units(spark, sf_dir).where(F.lower("text").rlike(r"\bname\b|\bcall (me|you)\b")).select("unit_id", "role", "text", naming_match("text").alias("n"))
    both = u.crossJoin(F.broadcast(asked))
    return both.select("query_id", "unit_id", F.round(perspective(asks_about(F.col("q")), F.col("role"), F.col("text"), F.col("n")), 6).alias("compat"))


# --- evaluation -----------------------------------------------------------------------------

_RANKS = (
    f"ff AS (SELECT id AS unit_id, text FROM eval_facts), {S.FACT_QUERIES}, {S.bm25('ff', 'text', 'fq')}, "
    "r AS (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm, 6) DESC, unit_id) AS rank FROM bm), "
    "gr AS (SELECT fq.query_id, min(rank) AS rank FROM fq LEFT JOIN r ON r.query_id = fq.query_id AND r.unit_id = fq.id AND rank <= 10 GROUP BY 1)"
)


@register(
    "recall_mrr",
    f"WITH {_RANKS} SELECT round(avg(coalesce(rank <= 1, false)::INT), 6) AS r1, round(avg(coalesce(rank <= 3, false)::INT), 6) AS r3, round(avg(coalesce(rank <= 5, false)::INT), 6) AS r5, "
    "round(avg(coalesce(rank <= 10, false)::INT), 6) AS r10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, count(*) AS n FROM gr",
)
def recall_of_facts(spark, sf_dir):
    asked = fact_queries(spark, sf_dir)
    q = query_terms(asked)
    ranked = top_k(bm25(q, bm25_index(fact_units(spark, sf_dir), q)).withColumn("bm", F.round("bm", 6)), 10, F.desc("bm"), "unit_id")
    gold = asked.select("query_id", F.col("id").alias("unit_id")).join(ranked, ["query_id", "unit_id"], "left").select("query_id", "rank")
    m = recall_mrr(gold)
    return m.select(*(F.round(c, 6).alias(c) for c in ("r1", "r3", "r5", "r10", "mrr")), "n")


def _words(x: str) -> str:
    s = rf"regexp_replace(lower(coalesce({x}, '')), '\b(a|an|the)\b', ' ', 'g')"
    s = rf"trim(regexp_replace(regexp_replace({s}, '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"list_filter(string_split({s}, ' '), lambda w: w <> '')"


_READER = "rr AS (SELECT i, ablation, any_value(ci) AS ci, any_value(cat) AS cat, any_value(gold) AS gold, any_value(pred) AS pred, any_value(f1) AS f1, any_value(em) AS em, any_value(bleu) AS bleu, any_value(hit) AS hit FROM reader_rows GROUP BY 1, 2)"


def _reader(spark, sf_dir):
    return load(spark, sf_dir, "reader_rows").groupBy("i", "ablation").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("ci", "cat", "gold", "pred", "f1", "em", "bleu", "hit")))


@register(
    "answer_f1",
    f"WITH {_READER}, w AS (SELECT i, ablation, {_words('pred')} AS p, {_words('gold')} AS g FROM rr), "
    "c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0)::DOUBLE AS n FROM w) "
    "SELECT i, ablation, round(CASE WHEN n > 0 THEN 2 * (n / len(p)) * (n / len(g)) / (n / len(p) + n / len(g)) ELSE 0 END, 6) AS f1, (p = g)::INT AS em, "
    "round(CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda x: list_contains(g, x))) / len(p)::DOUBLE ELSE 0 END, 6) AS bleu FROM c",
)
def answer_f1(spark, sf_dir):
    f1, em, bleu = answer_scores(F.col("pred"), F.col("gold"))
    return _reader(spark, sf_dir).select("i", "ablation", F.round(f1, 6).alias("f1"), em.alias("em"), F.round(bleu, 6).alias("bleu"))


@register(
    "reader_means",
    f"WITH {_READER} SELECT coalesce(ablation, 'all') AS ablation, coalesce(cat, -1)::INT AS cat, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(em), 6) AS em, round(avg(bleu), 6) AS bleu, round(avg(hit), 6) AS hit FROM rr GROUP BY ROLLUP (ablation, cat)",
)
def reader_means(spark, sf_dir):
    r = _reader(spark, sf_dir).rollup("ablation", "cat")
    means = r.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("f1", "em", "bleu", "hit")))
    return means.na.fill("all", ["ablation"]).na.fill(-1, ["cat"])


@register(
    "held_out_means",
    f"WITH {_READER} SELECT CASE WHEN ci < 5 THEN 'tuned' ELSE 'held-out' END AS split, ablation, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(hit), 6) AS hit FROM rr GROUP BY 1, 2",
)
def held_out_means(spark, sf_dir):
    split = F.when(F.col("ci") < 5, "tuned").otherwise("held-out").alias("split")
    return _reader(spark, sf_dir).groupBy(split, "ablation").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("hit"), 6).alias("hit"))


def _runs(spark, sf_dir, value):
    r = _reader(spark, sf_dir)
    return paired(r.where("ablation = 'full'"), r.where("ablation = 'lexical'"), "i", value)


@register(
    "mcnemar",
    f"WITH {_READER}, p AS (SELECT a.hit AS x, b.hit AS y FROM rr a JOIN rr b USING (i) WHERE a.ablation = 'full' AND b.ablation = 'lexical'), "
    "n AS (SELECT count(*) FILTER (WHERE x = 1 AND y = 0) AS b, count(*) FILTER (WHERE x = 0 AND y = 1) AS c FROM p) "
    "SELECT b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))) FROM generate_series(0, least(b, c)) t(k))) END, 6) AS p_exact FROM n",
)
def mcnemar_hits(spark, sf_dir):
    return mcnemar(_runs(spark, sf_dir, "hit")).select("b", "c", F.round("p_exact", 6).alias("p_exact"))


@register("permutation_test")
def permutation(spark, sf_dir):
    """Sign-flip test of the F1 of two runs."""
    out = permutation_test(_runs(spark, sf_dir, "f1"), "i")
    return out.select(F.round("mean_diff", 6).alias("mean_diff"), "n", F.round("p", 6).alias("p"))


@register("event_medians", "SELECT event_type, count(*) AS n, round(median(value), 6) AS median_value FROM events GROUP BY 1")
def event_medians(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median_value"))


@register(
    "stream_ingest",
    f"WITH {S.UNITS} SELECT unit_id, role, {S.fingerprint('text')} AS fp, len({S.tokens('cut')})::INT AS n_tokens FROM (SELECT *, text[1:CASE WHEN role = 'tool' THEN 500 ELSE 4000 END] AS cut FROM u) "
    "WHERE role IN ('user', 'assistant', 'tool') AND length(trim(text)) >= 3 AND regexp_matches(text, '[A-Za-z0-9]')",
)
def stream_ingest(spark, sf_dir):
    """Units captured by a stream, each once however often it was delivered."""
    return ingest_once(spark, f"{sf_dir}/trace_units.parquet").select("unit_id", "role", "fp", F.size("tokens").alias("n_tokens"))
