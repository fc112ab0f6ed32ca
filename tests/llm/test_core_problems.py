"""Problems 1, 2, 3 and 7 against brute force, with the defined edge cases."""

import time
from itertools import combinations

import numpy as np
import pytest

from spoor.llm import pairs, spans, terms, vectors


def _rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


# --- 1 ---------------------------------------------------------------------


def _brute(ids, x, k):
    s = np.round((x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)), 12)
    out = {}
    for i, u in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))
        out[u] = [ids[j] for j in order[:k]]
    return out


def test_vectors_match_brute_force_through_a_tree(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SMALL", 64)
    monkeypatch.setattr(vectors, "LEAF_SIZE", 40)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = np.round(centres[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16)), 4)
    ids = [f"u{i:04d}" for i in range(600)]
    df = spark.createDataFrame([(u, v.tolist()) for u, v in zip(ids, x)], "unit_id string, embedding array<double>")
    got = {}
    for r in vectors.similar_vectors(df, k=5, recall=0.99).collect():
        got.setdefault(r["unit_id"], set()).add(r["neighbour_id"])
    want = _brute(ids, x, 5)
    hit = sum(len(got.get(u, set()) & set(w)) for u, w in want.items())
    assert vectors.similar_vectors.report[16]["leaves"] > 4
    assert hit / (5 * len(ids)) >= 0.9
    assert all(len(v) == 5 for v in got.values())


def test_vectors_edge_cases(spark):
    same = [0.5, 0.5, 0.0]
    rows = [(f"c{i:02d}", same, 1) for i in range(14)] + [("c00", same, 2)]
    rows += [("z", [0.0, 0.0, 0.0], 1), ("n", None, 1), ("e", [], 1), ("h", [1.0, None, 0.0], 1), ("i", [float("nan"), 1.0, 0.0], 1)]
    rows += [("s", [1.0, 0.0], 1), ("t", [1.0, 0.01], 1), (None, same, 1)]
    df = spark.createDataFrame(rows, "unit_id string, embedding array<double>, rank int")
    found = vectors.similar_vectors(df, k=10, floor=0.9).collect()
    near = {}
    for r in found:
        near.setdefault(r["unit_id"], []).append((r["rank"], r["neighbour_id"], round(r["cosine"], 9)))
    # ties by id: the ten smallest others of a class of copies
    assert [n for _, n, _ in sorted(near["c13"])] == [f"c{i:02d}" for i in range(10)]
    assert [n for _, n, _ in sorted(near["c00"])] == [f"c{i:02d}" for i in range(1, 11)]
    assert [n for _, n, _ in near["s"]] == ["t"]
    assert not set(near) & {"z", "n", "e", "h", "i", None}
    assert vectors.similar_vectors(df.limit(0), k=3).count() == 0


# --- 2 ----------------------------------------------------------------------


def _shared(a, b, n):
    return any(a[i : i + n] in b for i in range(len(a) - n + 1))


def test_spans_match_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh _/.,0123é😀"), rng.integers(1, 9))) for _ in range(60)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(30)]
    texts = list(base)
    for _ in range(40):
        i, j = rng.integers(0, 30, 2)
        n, at = int(rng.integers(100, 150)), int(rng.integers(0, 60))
        texts.append(base[j][: int(rng.integers(0, 80))] + base[i][at : at + n] + base[j][-20:])
    texts += ["a" * 300, "b" + "a" * 119, "c" + "a" * 120, base[0], "", None, "x" * 119]
    ids = [f"u{i:03d}" for i in range(len(texts))]
    rows = [(u, t, "other", 5) for u, t in zip(ids, texts)] + [("u000", texts[0], "again", 6)]
    df = spark.createDataFrame(rows, "unit_id string, text string, th string, pos int")
    want = {(a, b) for (a, x), (b, y) in combinations(zip(ids, texts), 2) if x and y and _shared(x, y, 120)}
    assert _rows(spans.shared_pairs(df), "unit_id_a", "unit_id_b") == want
    assert len(want) > 20


def test_shared_share(spark):
    core = "".join(chr(97 + (i * 7 + i // 26) % 26) for i in range(200))
    rows = [("a", "1" * 50 + core), ("b", core + "2" * 100), ("c", "3" * 300), ("d", "4" * 150), ("e", "4" * 150), ("f", None), ("g", "")]
    got = {r["unit_id"]: (r["n_chars"], r["shared_chars"], r["share"]) for r in spans.shared_spans(spark.createDataFrame(rows, "unit_id string, text string")).collect()}
    assert got["a"] == (250, 200, 0.8) and got["b"] == (300, 200, 0.666667)
    assert got["c"] == (300, 0, 0.0) and got["d"] == (150, 150, 1.0) and got["g"] == (0, 0, 0.0) and "f" not in got
    assert spans.shared_pairs(spark.createDataFrame([], "unit_id string, text string")).count() == 0


# --- 3 -----------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [2, 3, 128])
def test_pairs_match_brute_force_whatever_the_chunk(spark, chunk):
    rng = np.random.default_rng(5)
    rows = [(f"u{i}", [f"e{j}" for j in rng.integers(0, 12, rng.integers(0, 9))], "x") for i in range(60)]
    rows += [("n", None, "x"), ("b", [" ", None, "E1 ", "e1"], "x"), ("u0", rows[0][1], "y")]
    df = spark.createDataFrame(rows, "unit_id string, entities array<string>, n string")
    sets = {u: {e.strip().lower() for e in es or [] if e and e.strip()} for u, es, _ in rows}
    sets = {u: s for u, s in sets.items() if s}
    count, single = {}, {}
    for s in sets.values():
        for e in s:
            single[e] = single.get(e, 0) + 1
        for p in combinations(sorted(s), 2):
            count[p] = count.get(p, 0) + 1
    got = {(r["item_a"], r["item_b"]): r for r in pairs.pair_counts(df, chunk=chunk).collect()}
    assert {k: r["n_ab"] for k, r in got.items()} == count
    for (a, b), r in got.items():
        assert (r["n_a"], r["n_b"], r["n"]) == (single[a], single[b], len(sets))
        assert r["lift"] == pytest.approx(count[a, b] * len(sets) / (single[a] * single[b]))
    assert pairs.pair_counts(df.limit(0)).count() == 0


# --- 7 -------------------------------------------------------------------------


def test_terms_and_ngrams_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(terms, "BLOCK_TERMS", 50)
    rng = np.random.default_rng(9)
    rows = [(f"u{i}", [str(w) for w in rng.choice(["a", "b", "c", "B ", " "], rng.integers(0, 12))], None, 1) for i in range(80)]
    rows += [("n", None, ["X", "x"], 1), ("only", ["rare"], [None], 1), ("u0", rows[0][1], None, 2)]
    df = spark.createDataFrame(rows, "unit_id string, tokens array<string>, entities array<string>, n int")
    want: dict = {}
    for u, toks, ents, _ in {r[0]: r for r in rows}.values():
        for field, listed, n_max in (("tokens", toks, 3), ("entities", ents, 3)):
            clean = [t.strip().lower() for t in listed or [] if t and t.strip()]
            for n in range(1, n_max + 1):
                grams = [terms.JOINER.join(clean[i : i + n]) for i in range(len(clean) - n + 1)]
                for g in grams:
                    c = want.setdefault((field, n, g), [0, set()])
                    c[0] += 1
                    c[1].add(u)
    got = {(r["field"], r["n"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in terms.term_counts(df, n_max=3).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: (c, len(u)) for k, (c, u) in want.items()}
    assert got["tokens", 1, "rare"][2] == "rare" and got["tokens", 1, "a"][2] == "common" and got["entities", 1, "x"] == (2, 1, "rare")
    assert terms.term_counts(df.limit(0)).count() == 0


def test_suffix_arrays_match_brute_force():
    rng = np.random.default_rng(4)
    for trial in range(30):
        sizes = rng.integers(1, 14, rng.integers(1, 9))
        codes = rng.integers(0, 3, sizes.sum())
        record = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        suffix = [tuple(codes[i : ends[i]]) for i in range(len(codes))]
        order, lcp = terms.suffix_array(codes, record)
        assert [suffix[i] for i in order] == sorted(suffix)
        common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert lcp.tolist() == [0] + [common(suffix[a], suffix[b]) for a, b in zip(order, order[1:])]
        want: dict = {}
        for i, s in enumerate(suffix):
            for n in range(1, len(s) + 1):
                c = want.setdefault((n, s[:n]), [0, set()])
                c[0] += 1
                c[1].add(int(record[i]))
        got = {(n, tuple(codes[a : a + n])): (o, r) for n, at, size, records in terms.ngram_intervals(codes, record, None) for a, o, r in zip(at, size, records)}
        assert got == {k: (c, len(r)) for k, (c, r) in want.items()}


def test_walks_are_best_first():
    import heapq

    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = vectors.fit_tree(x, 12)
    assert tree.leaves > 40
    got = tree.walk(x[:60], 9)
    for row, leaves in zip(x[:60], got):
        queue, seen = [(0.0, 0)], []
        while queue and len(seen) < 9:
            _, node = heapq.heappop(queue)
            if not len(tree.children[node]):
                seen.append(node)
            for c in tree.children[node]:
                heapq.heappush(queue, (-float(tree.centroids[c] @ row), int(c)))
        assert leaves.tolist() == seen
    every = tree.walk(x[:20], tree.leaves)
    assert all(sorted(r) == sorted(n for n, c in enumerate(tree.children) if not len(c)) for r in every.tolist())


def test_queries_of_a_leaf_are_split(spark, monkeypatch):
    """Blocks and chunks change no result."""
    rng = np.random.default_rng(3)
    rows = [(f"u{i:04d}", np.round(rng.normal(size=6), 4).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "unit_id string, embedding array<double>")
    want = _rows(vectors.similar_vectors(df, k=4), "unit_id", "rank", "neighbour_id")
    monkeypatch.setattr(vectors, "BLOCK", 60)
    monkeypatch.setattr(vectors, "CHUNK", 70)
    assert _rows(vectors.similar_vectors(df, k=4), "unit_id", "rank", "neighbour_id") == want and len(want) == 2000


def test_vectors_are_compared_in_rounds_that_leave_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SMALL", 64)
    monkeypatch.setattr(vectors, "LEAF_SIZE", 40)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 8)), 3)
    df = spark.createDataFrame([(f"u{i}", v.tolist()) for i, v in enumerate(x)], "unit_id string, embedding array<double>")
    want = _rows(vectors.similar_vectors(df, k=4), "unit_id", "rank", "neighbour_id")
    monkeypatch.setattr(vectors, "ROUND", 1)
    files = lambda: int(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size())
    written, kept = [], vectors.materialize

    def write(d, name):
        written.append(name)
        return kept(d, name)

    monkeypatch.setattr(vectors, "materialize", write)
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    before = files()
    found = vectors.similar_vectors(df, k=4)
    time.sleep(1)
    assert files() <= before
    visits = vectors.similar_vectors.report[8]["visits"]
    assert written.count("p1-hits") == visits > 1 and _rows(found, "unit_id", "rank", "neighbour_id") == want and len(want) == 1600
