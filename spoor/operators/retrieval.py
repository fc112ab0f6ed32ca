"""The retrieval pipeline over batches of queries.

Only units that a query touches are scored: through a term, an entity, a near
vector or, for questions about names, a naming statement. All others score 0
or less and could not be found; their part in the statistics of a pool (a
least score of 0) follows from counts. Scores are made in the memory of the
tasks (``scoring``): a first pass gives the extremes of the pools, a second the
best units. Only queries into whose best units another could be pulled by closure
have all their seeds written, in a third.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions.text import asks_type, entities, fingerprint, is_identity_query, is_temporal, min_max, mmr_lambda, names_date, names_number, tokens
from spoor.operators import scoring
from spoor.operators.graph import entity_hits, entity_weights, ppr, similar_hits, unit_entities
from spoor.operators.identity import asks_about, names_someone, naming_match, perspective
from spoor.operators.lexical import frequencies, numbered, query_terms, term_lists
from spoor.operators.ranking import first_of_each, mmr, top_k
from spoor.runtime import materialize, swept
from spoor.sources.units import adjacent


@dataclass(frozen=True)
class Options:
    scope_to_project: bool = True
    top_k: int = 5
    recent_exclude_ms: int = 120_000
    rho: float = 0.6
    min_score: float = 0.15
    use_mmr: bool = True
    mmr_lambda: float | None = None
    hybrid: bool = True
    fusion: str = "coverage"
    semantic_weight: float = 0.5
    federate: bool = True
    federate_penalty: float = 0.7
    federate_gate: float = 0.45
    federate_margin: float = 0.15
    use_closure: bool = True
    closure_entity: float = 0.35
    closure_turn: float = 0.25
    use_bridges: bool = True
    gamma: float = 0.6
    calibrate: bool = True
    perspective_weight: float = 0.3
    identity_demotion: float = 0.4
    #: Without effect: what ``dense`` holds is scored, all of it.
    dense_pool: int = 200

    @property
    def pool(self) -> int:
        return max(4 * self.top_k, self.top_k + 10) if self.use_mmr else self.top_k


def query_features(queries: DataFrame, o: Options) -> DataFrame:
    """Queries with their terms counted, entities, routing and class; those without term and entity left out."""
    q = queries.withColumn("n_toks", F.size(tokens(F.col("text")))).withColumn("q_ents", entities(F.col("text")))
    relational = (F.size("q_ents") > 0) & ~is_temporal(F.col("text"))
    return q.where((F.col("n_toks") > 0) | (F.size("q_ents") > 0)).select(
        "query_id",
        F.col("text").alias("q_text"),
        F.col("cwd").alias("q_cwd"),
        F.col("session_id").alias("q_session"),
        F.col("now").alias("q_now"),
        "n_toks",
        "q_ents",
        F.when(relational, o.rho).otherwise(1 - o.rho).alias("w_graph"),
        is_identity_query(F.col("text")).alias("q_identity"),
        asks_about(F.col("text")).alias("q_about"),
        asks_type(F.col("text")).alias("q_type"),
    )


def excluded(q: DataFrame, meta: DataFrame, context: DataFrame | None, o: Options) -> DataFrame:
    """(query_id, unit_id): fresh units of the query's own session, and units whose fingerprint is in its context."""
    own = meta.select("unit_id", "session_id", "ts").join(
        q.where("q_session is not null").select("query_id", F.col("q_session").alias("session_id"), "q_now"), "session_id"
    )
    out = own.where(F.col("ts") >= F.col("q_now") - o.recent_exclude_ms).select("query_id", "unit_id")
    if context is not None:
        out = out.unionByName(meta.select("unit_id", "fp").join(context.select("query_id", "fp"), "fp").select("query_id", "unit_id")).distinct()
    return out


def fused(o: Options, dense: bool):
    """The relevance of a unit in its pool from bn, sn, cov and the pool's confidences."""
    bn = min_max(F.coalesce("bm", F.lit(0.0)), F.col("bm_min"), F.col("bm_max"))
    if not dense:
        return bn * F.col("bm_conf")
    sn = min_max(F.coalesce("sem", F.lit(0.0)), F.col("sem_min"), F.col("sem_max"))
    if not o.hybrid:
        return sn * F.col("sem_conf")
    conf = F.greatest("bm_conf", "sem_conf")
    if o.fusion == "max":
        return F.greatest(bn, sn) * conf
    if o.fusion == "coverage":
        return (F.col("cov") * bn + (1 - F.col("cov")) * sn) * conf
    w = min(1.0, max(0.0, o.semantic_weight))
    return ((1 - w) * bn + w * sn) * conf


FOUND = "query_id string, rank int, unit_id string, score double, reason string, compat int"


def _described(units: DataFrame, asked: pa.Table, o: Options, vectors: bool) -> DataFrame:
    """What scoring asks of a unit besides its words, without its text: (unit_id, toks, more...)."""
    text = F.coalesce("text", F.lit(""))
    more = []
    if o.calibrate and pc.any(pc.is_valid(asked.column("q_type"))).as_py():
        more += [names_date(text).alias("names_date"), names_number(text).alias("names_number")]
    if pc.any(pc.is_valid(asked.column("q_about"))).as_py():
        units = units.withColumn("naming", naming_match(F.when(names_someone(F.col("text")), F.col("text"))))
        for about in ("you", "me"):
            speaks = perspective(F.lit(about), F.col("role"), F.col("text"), F.col("naming"))
            more += [speaks.alias(f"pc_{about}"), F.coalesce(names_someone(F.col("text")) & (speaks > 0), F.lit(False)).alias(f"tells_{about}")]
    if vectors:
        more.append(F.col("embedding").cast("array<double>").alias("embedding"))
    return units.select("unit_id", tokens(F.col("text")).alias("toks"), "session_id", "cwd", "ts", "seq", fingerprint(text).alias("fp"), "ents", *more)


def _vectors(asked_vectors: DataFrame, named: pa.Array) -> dict:
    """(query numbers, normal vectors) by length."""
    with swept(asked_vectors.sparkSession):
        t = asked_vectors.where(F.size("qvec") > 0).select("query_id", F.col("qvec").cast("array<double>").alias("qvec")).toArrow()
    number = pc.index_in(t.column("query_id"), value_set=named).fill_null(-1).to_numpy()
    lists = t.column("qvec").combine_chunks()
    sizes, out = lists.value_lengths().to_numpy(), {}
    for dim in np.unique(sizes):
        at = np.flatnonzero((sizes == dim) & (number >= 0))
        at = at[np.argsort(number[at])]
        x = np.asarray(lists.take(pa.array(at)).flatten(), "f8").reshape(-1, int(dim))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        out[int(dim)] = (number[at], np.divide(x, norm, out=np.zeros_like(x), where=norm > 0))
    return out


def _pools(blocks: DataFrame, held, n: int, n_units: int) -> np.ndarray:
    """What each pool of each query is scaled by; units not touched have the least score of 0."""
    found = blocks.mapInArrow(scoring.extremes(held), scoring.STATS).groupBy("q", "inside")
    sums, least, most = ("n", "touched", "n_bm", "n_sem"), ("bm_lo", "sem_lo"), ("bm_hi", "sem_hi")
    with swept(blocks.sparkSession):
        t = found.agg(*(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most)).where("touched > 0").toArrow()
    c = {name: t.column(name).to_numpy() for name in t.column_names}
    pools = np.zeros((n, 2, 6))
    scale = {}
    for kind in ("bm", "sem"):
        scale[kind] = np.where(c[f"n_{kind}"] >= c["n"], c[f"{kind}_lo"], 0.0), np.where(c[f"n_{kind}"] > 0, c[f"{kind}_hi"], 0.0)
    anchor = max(1.2, min(4.0, 1.2 + n_units / 200))
    bm_conf = np.minimum(1.0, scale["bm"][1] / anchor)
    sem_conf = np.minimum(1.0, np.maximum(0.0, (2 * scale["sem"][1] - 1 - 0.55) / 0.25))
    pools[c["q"], c["inside"].astype(int)] = np.stack([*scale["bm"], bm_conf, *scale["sem"], sem_conf], axis=1)
    return pools


def retrieve(
    queries: DataFrame,
    units: DataFrame,
    options: Options | None = None,
    context: DataFrame | None = None,
    dense: DataFrame | None = None,
    entity_vectors: DataFrame | None = None,
    asked_vectors: DataFrame | None = None,
) -> DataFrame:
    """(query_id, rank, unit_id, score, reason, compat) for queries (query_id, text, cwd, session_id, now).

    ``units`` is the unit table; ``context`` (query_id, fp) names what a query
    already sees; ``dense`` (query_id, unit_id, sem) holds similarities in
    [0, 1] of the units a vector search has found; others count 0, as with an
    approximate index. With ``asked_vectors`` (query_id, qvec) every unit whose ``embedding`` is
    of equal length is compared, in the tasks, and ``dense`` is not read. ``entity_vectors`` (entity, embedding) lets units of
    entities similar to those of a query seed PageRank too.
    """
    o = options or Options()
    spark, is_dense = units.sparkSession, dense is not None or asked_vectors is not None
    context_of = spark.sparkContext
    q = materialize(query_features(queries, o), "q")
    with swept(spark):
        asked = q.select("query_id", "q_cwd", F.col("q_session").isNotNull().alias("in_session"), "w_graph", "q_identity", "q_about", "q_type").toArrow()
        terms = query_terms(queries).toArrow()
    n = asked.num_rows
    if not n:
        return spark.createDataFrame([], FOUND)
    named = asked.column("query_id").combine_chunks()
    names = F.broadcast(spark.createDataFrame(pa.table({"query_id": named, "q": pa.array(np.arange(n), pa.int32())})))
    words, starts, number, qn = numbered(terms, named)
    # derived once, without texts: every step below reads it
    docs = materialize(term_lists(_described(units, asked, o, asked_vectors is not None), words), "retrieve-units")
    n_units, avgdl, df = frequencies(docs, len(words))
    weights = qn * np.log(1 + (n_units - df + 0.5) / (df + 0.5))[number]
    of = np.repeat(np.arange(n), np.diff(starts))
    total = np.bincount(of, qn, n)
    cov = np.divide(np.bincount(of, np.where(df[number] > 0, qn, 0), n), total, out=np.zeros(n), where=total > 0)
    # the graph
    postings = unit_entities(docs)
    q_ents = q.select("query_id", F.explode("q_ents").alias("entity"))
    direct = entity_hits(q_ents, postings)
    if o.use_bridges:
        seeds = direct.select("query_id", "unit_id", F.col("hits").cast("double").alias("seed"))
        if entity_vectors is not None:
            seeds = seeds.unionByName(similar_hits(q_ents, postings, entity_vectors)).groupBy("query_id", "unit_id").agg(F.sum("seed").alias("seed"))
        graph = ppr(seeds, postings, entity_weights(postings, docs.agg(F.count("*").alias("n_units"))), o.gamma).withColumnRenamed("mass", "g_raw")
    else:
        graph = direct.select("query_id", "unit_id", F.col("hits").cast("double").alias("g_raw"))
    graph = materialize(graph.join(names, "query_id").groupBy("unit_id").agg(F.collect_list(F.struct("q", "g_raw")).alias("l")).select("unit_id", F.col("l.q").alias("gq"), F.col("l.g_raw").alias("gv")), "graph")
    with swept(spark):
        g = graph.select(F.inline(F.arrays_zip("gq", "gv")).alias("q", "g")).groupBy("q").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).toArrow()
    g_min, g_max = np.full(n, np.nan), np.full(n, np.nan)
    g_min[g.column("q").to_numpy()], g_max[g.column("q").to_numpy()] = g.column("lo").to_numpy(), g.column("hi").to_numpy()
    # units with what is known of them by query, in as many parts as work at once
    projects = pc.unique(asked.column("q_cwd")) if o.scope_to_project else pa.array([None], pa.string())
    blocks = docs.join(graph, "unit_id", "left")
    if o.scope_to_project:
        code = spark.createDataFrame(pa.table({"of": projects, "project": pa.array(np.arange(len(projects)), pa.int32())}))
        blocks = blocks.join(F.broadcast(code), F.col("cwd").eqNullSafe(F.col("of")), "left").drop("of").na.fill(-1, ["project"])
        project = pc.index_in(asked.column("q_cwd"), value_set=projects).to_numpy()
    else:
        blocks, project = blocks.withColumn("project", F.lit(0)), np.zeros(n, "i4")
    out = None
    if context is not None or pc.any(asked.column("in_session")).as_py():
        out = materialize(excluded(q, docs, context, o).join(names, "query_id").select("q", "unit_id"), "excluded")
        blocks = blocks.join(out.groupBy("unit_id").agg(F.collect_list("q").alias("gone")), "unit_id", "left")
    if dense is not None and asked_vectors is None:
        lists = dense.where("sem IS NOT NULL").join(names, "query_id").groupBy("unit_id").agg(F.collect_list(F.struct("q", F.col("sem").cast("double").alias("s"))).alias("l"))
        blocks = blocks.join(lists.select("unit_id", F.col("l.q").alias("sq"), F.col("l.s").alias("sv")), "unit_id", "left")
    blocks = materialize(blocks.drop("session_id", "cwd", "ts", "ents").repartition(max(context_of.defaultParallelism, n_units // scoring.BLOCK + 1)), "retrieve-blocks")
    known = scoring.Asked(
        starts, number, weights, avgdl if avgdl and avgdl > 0 else 1.0, project, asked.column("w_graph").to_numpy(), cov, asked.column("q_identity").to_numpy(),
        asked.column("q_about").fill_null("").to_pylist(), asked.column("q_type").fill_null("").to_pylist(), _vectors(asked_vectors, named) if asked_vectors is not None else {}, g_min, g_max,
    )
    known = dataclasses.replace(known, pools=_pools(blocks, context_of.broadcast(known), n, n_units))
    held = context_of.broadcast(known)
    best = materialize(blocks.mapInArrow(scoring.best(held, o, is_dense), scoring.BEST), "retrieve-best")
    # federation: a weak project lets others in
    with swept(spark):
        t = best.where("unit_id IS NULL").groupBy("q", "inside").agg(F.max("score").alias("s")).toArrow()
    top = np.zeros((n, 2))
    top[t.column("q").to_numpy(), t.column("inside").to_numpy().astype(int)] = t.column("s").to_numpy()
    weak = (top[:, 1] <= max(o.min_score, o.federate_gate)) & ((top[:, 1] <= o.min_score) | (top[:, 0] > top[:, 1] + o.federate_margin))
    opened = weak & (o.federate and o.scope_to_project)
    asked_for = spark.createDataFrame(
        pa.table({"q": pa.array(np.arange(n), pa.int32()), "query_id": named, "opened": opened, "q_type": asked.column("q_type").combine_chunks(), "project": pa.array(project, pa.int32())})
    )
    asked_for = F.broadcast(asked_for)
    # candidate order: units of the project, then others, each by arrival
    ord_ = F.struct((~F.col("inside")).alias("cross"), F.col("seq"), F.col("unit_id")).alias("ord")
    label = f"hybrid:{o.fusion}" if is_dense and o.hybrid else "semantics" if is_dense else "lexical"
    reason = F.concat(F.when(F.col("by_graph") & F.col("by_text"), f"graph+{label}").when(F.col("by_graph"), "graph").otherwise(label), F.when(F.col("inside"), "").otherwise("+cross-project"))
    found = best.where("unit_id IS NOT NULL").join(asked_for, "q").where("inside OR opened")
    found = found.select("q", "unit_id", "fp", F.col("score").alias("raw"), reason.alias("reason"), "compat", F.lit(-1).alias("kind"), ord_, "seq")
    order = [F.desc("score"), F.col("kind") >= 0, "ord", "kind", "seq", "unit_id"]

    def ranked(rows: DataFrame) -> DataFrame:
        first = first_of_each(rows.withColumn("score", F.round("raw", 9)), "fp", *order, by="q")
        return top_k(first, o.pool, F.desc("score"), F.desc("compat"), *order[1:], by="q")

    if o.use_closure:
        with swept(spark):
            t = ranked(found).groupBy("q").agg(F.max("raw").alias("best"), F.max(F.when(F.col("rank") == o.pool, F.col("score"))).alias("last")).toArrow()
        numbers, most = t.column("q").to_numpy(), max(o.closure_entity, o.closure_turn) * t.column("best").to_numpy()
        # what a closed unit must score: the floor, and the last of as many as are wanted
        least = np.maximum(t.column("last").to_numpy(zero_copy_only=False).astype("f8"), o.min_score)
        least = np.where(np.isnan(least), o.min_score, least) - 1e-8
        pulled = (most > o.min_score) & (most >= least)
        if pulled.any():
            wanted = np.sort(numbers[pulled])
            held = context_of.broadcast(dataclasses.replace(known, opened=opened))
            seeds = blocks.mapInArrow(scoring.seeds(held, o, is_dense, wanted), scoring.SEEDS)
            seeds = materialize(seeds.select("q", "unit_id", ord_, "score"), "seeds")
            floor = spark.createDataFrame(pa.table({"q": pa.array(numbers[pulled], pa.int32()), "least": least[pulled]}))
            near = blocks.select("unit_id", "project", "fp", "seq", *(c for c in blocks.columns if c.startswith("names_")))
            found = found.unionByName(closure(seeds, floor, docs, near, asked_for, out, o))
    pool = ranked(found.where(F.col("raw") > o.min_score)).join(asked_for, "q")
    final = pool.select("query_id", "unit_id", F.col("rank").alias("place"), "score", "reason", "compat")
    if not o.use_mmr:
        return final.select("query_id", F.col("place").alias("rank"), "unit_id", "score", "reason", "compat").where(F.col("rank") <= o.top_k)
    final = materialize(final, "pool")
    lam = F.lit(o.mmr_lambda) if o.mmr_lambda is not None else mmr_lambda(F.col("q_text"), F.size("q_ents"), F.col("n_toks"))
    vectors = units.select("unit_id", F.col("embedding") if "embedding" in units.columns else F.lit(None).cast("array<double>").alias("embedding"), tokens(F.col("text")).alias("toks"))
    picked = mmr(final.join(q.select("query_id", lam.alias("lam")), "query_id").join(vectors, "unit_id").select("query_id", "unit_id", "place", "score", "lam", "embedding", "toks"), o.top_k)
    return picked.join(final, ["query_id", "unit_id"]).select("query_id", "rank", "unit_id", "score", "reason", "compat")


def closure(seeds: DataFrame, floor: DataFrame, docs: DataFrame, near: DataFrame, asked: DataFrame, out: DataFrame | None, o: Options) -> DataFrame:
    """Units that seeds (q, unit_id, ord, score) pull in: by a shared entity, as the turn before, or the turn after.

    The first seed in candidate order to reach a unit sets its score. For
    shared entities that seed is found by entity first, so a common entity
    costs its units once a query, not once a seed. Only units that some seed would lift to what
    their query asks at least (``floor``: q, least) are looked at; the first of all their seeds decides.
    """
    postings = unit_entities(docs)
    near = near.withColumnRenamed("project", "of")
    first = materialize(seeds.join(postings, "unit_id").groupBy("q", "entity").agg(F.min(F.struct("ord", "score")).alias("s")), "closure-first")
    turns = seeds.join(adjacent(docs), "unit_id").join(F.broadcast(floor), "q")
    before = turns.where("prev_id is not null").select("q", F.col("prev_id").alias("unit_id"), "ord", F.lit(1).alias("kind"), "score", "least")
    after = turns.where("next_id is not null").select("q", F.col("next_id").alias("unit_id"), "ord", F.lit(2).alias("kind"), "score", "least")
    turns = materialize(before.unionByName(after), "closure-turns")
    lifts = first.join(F.broadcast(floor), "q").where(F.col("s.score") * o.closure_entity >= F.col("least")).select("q", "entity")
    lifts = lifts.join(asked.select("q", "project"), "q")
    # a unit of another project is never pulled in
    inside = (F.col("of") == F.col("project")) if o.scope_to_project else F.lit(True)
    held = postings.join(near.select("unit_id", "of"), "unit_id").where("of >= 0")
    shared = lifts.join(held, "entity").where(inside).select("q", "unit_id")
    reached = shared.unionByName(turns.where(F.col("score") * o.closure_turn >= F.col("least")).select("q", "unit_id")).distinct()
    reached = reached.join(seeds.select("q", "unit_id"), ["q", "unit_id"], "left_anti")
    if out is not None:
        reached = reached.join(out, ["q", "unit_id"], "left_anti")
    reached = materialize(reached, "closure-reached")
    by_entity = reached.join(postings, "unit_id").join(first, ["q", "entity"]).select("q", "unit_id", "s.ord", F.lit(0).alias("kind"), "s.score")
    by_turn = turns.join(reached, ["q", "unit_id"]).select("q", "unit_id", "ord", "kind", "score")
    set_by = by_entity.unionByName(by_turn).groupBy("q", "unit_id").agg(F.min(F.struct("ord", "kind", "score")).alias("s"))
    full = set_by.join(near, "unit_id").join(asked, "q").where(inside)
    turn = F.col("s.kind") > 0
    compat = F.lit(0)
    if "names_date" in near.columns:
        compat = F.when(F.col("q_type") == "when", F.col("names_date").cast("int")).when(F.col("q_type") == "many", F.col("names_number").cast("int")).otherwise(0)
    return full.select(
        "q",
        "unit_id",
        "fp",
        (F.col("s.score") * F.when(turn, o.closure_turn).otherwise(o.closure_entity)).alias("raw"),
        F.when(turn, "closure:adjacent-turn").otherwise("closure:shared-entity").alias("reason"),
        compat.alias("compat"),
        F.col("s.kind").alias("kind"),
        F.col("s.ord").alias("ord"),
        "seq",
    )
