"""Problems 4, 5, 6, 8, 9 and 10, with the defined edge cases."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoor.llm import conversations, mixing, packing, pii, reading, tokens, truncation

# --- 4 ----------------------------------------------------------------------------

NAMES = pii.Names(
    [(n, "given") for n in "Anna Berta Clara Dorina Marina Karina Cedar Juniper".split()]
    + [(n, "family") for n in "Holmgrave Stonegrave Redgrave Firmoor Tellmoor Kastmoor Greenby Oldby Newby Farby Westby".split()]
)


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("write to mailto:anna.k@site.example now", "email", "anna.k@site.example"),
        ("at <ANNA_K@SITE.EXAMPLE>, please", "email", "ANNA_K@SITE.EXAMPLE"),
        ("anna [at] site [dot] example bounced", "email", "anna [at] site [dot] example"),
        ("anna.k (at) site.example.org bounced", "email", "anna.k (at) site.example.org"),
        ("anna dot k at site dot example dot org waits", "email", "anna dot k at site dot example dot org"),
        ("Tel +49(0)30/23125-417; ask", "phone", "+49(0)30/23125-417"),
        ("call (613) 555 0152 today", "phone", "(613) 555 0152"),
        ("(01632 960 628)", "phone", "01632 960 628"),
        ("ring 01.99.00.23.94.", "phone", "01.99.00.23.94"),
        ("+1-808-555-0195 ext. 10 is", "phone", "+1-808-555-0195 ext. 10"),
        ("wants 947-19-7490 next", "id_number", "947-19-7490"),
        ("the QQ 26 60 95 B leaked", "id_number", "QQ 26 60 95 B"),
        ("tax id: 06393865185 in", "id_number", "06393865185"),
        ("Reisepass Nr. XT0001630.", "id_number", "XT0001630"),
        ("at 154 Clartwood Lane, Town bis", "street_address", "154 Clartwood Lane, Town"),
        ("to 2875 Rurv St., Apt 6B, Town, ZZ 00525, up", "street_address", "2875 Rurv St., Apt 6B, Town, ZZ 00525"),
        ("an 76 vandwood ln in rourtmere bis", "street_address", "76 vandwood ln in rourtmere"),
        ("77 rue de Dorme, 00577 Ville bis", "street_address", "77 rue de Dorme, 00577 Ville"),
        ("in Lindenstraße 28, 00328 Stadt.", "street_address", "Lindenstraße 28, 00328 Stadt"),
        ("Calle Goul 136, 3º B, Villa.", "street_address", "Calle Goul 136, 3º B, Villa"),
        ("ask Dr. Anna Greenby about", "person_name", "Anna Greenby"),
        ("ask Greenby, Anna about", "person_name", "Greenby, Anna"),
        ("by A. Holmgrave, tag", "person_name", "A. Holmgrave"),
        ("with Anna C. Oldby at", "person_name", "Anna C. Oldby"),
        ("with berta newby at", "person_name", "berta newby"),
        ("BERTA NEWBY signed", "person_name", "BERTA NEWBY"),
        ("Anna Farby-Westby:", "person_name", "Anna Farby-Westby"),
        ("Juniper Unkgrave left", "person_name", "Juniper Unkgrave"),
    ],
)
def test_items(text, kind, value):
    found = pii.find(text, NAMES)
    assert [(k, text[s:e]) for s, e, k in found] == [(kind, value)]


@pytest.mark.parametrize(
    "text",
    [
        None, "", "   ", "the job id 86972678117 is strict", "ticket 4385-8369-2b3726b is closed", "batch 41297-135-7857 went through", "pinned `widget@3.20.3` for now",
        "a+b@511a5dc is the image tag", "2025-01-05 22:03:44.352 INFO x", "listening on 10.0.168.117 port 8287", "Cedar Relay and Juniper Store both store",
        "see line 126, Juniper Street demo, row 175", "set X to 8927 and close the gate", "the @cache decorator", "177 road segments and 167 lane marks",
    ],
)
def test_no_items(text):
    assert pii.find(text, NAMES) == []


def test_checksums_and_redaction(spark):
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.mod11_10("86095742719")
    text = "😀 mail anna@site.example or pay 4111 1111 1111 1111"
    spans = pii.find(text, NAMES)
    assert pii.redact(text, spans) == "😀 mail [EMAIL] or pay [PAYMENT]" and spans[0][0] == 7
    rows = [("a", text, 1), ("a", text, 1), ("b", None, 1), ("c", "x " * 50_000 + "anna@site.example", 1)]
    df = spark.createDataFrame(rows, "unit_id string, text string, kind int")
    names = spark.createDataFrame([], "name string, kind string")
    got = {(r["unit_id"], r["kind"], r["start_pos"]) for r in pii.personal_items(df, names).collect()}
    assert got == {("a", "email", 7), ("a", "payment", 32), ("c", "email", 100_000)}
    assert pii.personal_items(df.limit(0), names).count() == 0
    assert {r["unit_id"]: r["items"] for r in pii.redacted(df, names).collect()} == {"a": 2, "b": 0, "c": 1}


# --- 5 ------------------------------------------------------------------------------


def test_truncation(spark):
    rng = np.random.default_rng(2)
    nouns, verbs = "node edge cache queue index shard table batch".split(), "load drop move scan pack sort".split()
    whole = [f"We {v} the {a} {n} near the {m} after a while. The {n} and the {m} {v} well together now" for v in verbs for a in ("old", "new", "big") for n in nouns for m in nouns]
    rng.shuffle(whole)
    rows = [(f"w{i}", t + ".", "assistant") for i, t in enumerate(whole)]
    rows += [(f"q{i}", t, "user") for i, t in enumerate(whole[:60])]
    rows += [(f"k{i}", t[: -int(rng.integers(12, 30))].rstrip() or t, "assistant") for i, t in enumerate(whole[60:120])]
    rows += [("m", "The cache drops the sha…", "user"), ("j", '[tool:x] {"a": "b', "tool"), ("J", '[tool:x] {"a": "b"}', "tool"), ("f", "```py\nx = 1\n```", "assistant")]
    rows += [(f"y{i}", "looks right to me", "user") for i in range(8)] + [("n", None, "user"), ("b", "  \t", None), ("w0", rows[0][1], "assistant")]
    df = spark.createDataFrame([(*r, "?") for r in rows], "unit_id string, text string, role string, th string")
    got = {r["unit_id"]: r["cut"] for r in truncation.truncation(df).collect()}
    assert got["m"] and got["j"] and not got["J"] and not got["f"]
    assert "n" not in got and "b" not in got and not any(got[f"y{i}"] for i in range(8))
    assert not any(got[f"w{i}"] for i in range(len(whole)))
    assert sum(got[f"k{i}"] for i in range(60)) >= 50
    assert sum(got[f"q{i}"] for i in range(60)) <= 10
    assert truncation.truncation(df.limit(0)).count() == 0


def test_near_copy_alignment():
    full = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    assert truncation.ends_early(full[: full.index("sixt") + 2], full) == "cut"
    assert truncation.ends_early(full.replace(" sixteen", ""), full) == "cut"
    done = full.replace("fifteen", "fifteen.")
    assert truncation.ends_early(done.replace(" sixteen", ""), done) == "complete"
    assert truncation.ends_early("a b c d e f", full) is None and truncation.ends_early(full, full) == "near"
    # containment, not resemblance: a copy may have lost more than it kept
    assert truncation.ends_early(full[: full.index("eleven") + 3], full) == "cut"


def test_near_copies_overrule_marks(spark):
    """A copy that stops where others go on is cut, even after a closing mark; it need not be next to the longest of its bucket."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for g in range(6):
        full = [word() for _ in range(60)]
        for k in range(6):
            rows.append((f"g{g}v{k}", " ".join([*full[:-1], word(), word()]) + "."))
        rows += [(f"g{g}cut", " ".join(full[:54])), (f"g{g}done", " ".join(full[:50]) + "."), (f"g{g}odd", " ".join(full[:52]) + '!"')]
    texts = spark.createDataFrame(rows, "unit_id string, text string").selectExpr("unit_id", "text", "xxhash64(text) AS th")
    whole = {r["unit_id"]: r["whole"] for r in texts.join(truncation.near_copies(texts), "th").collect()}
    assert all(whole[f"g{g}cut"] == 0 for g in range(6))
    assert not any(whole.get(f"g{g}v{k}") == 0 for g in range(6) for k in range(6))
    df = texts.selectExpr("unit_id", "text", "'user' AS role")
    got = {r["unit_id"]: r["verdict"] for r in truncation.truncation(df).collect()}
    assert all(got[f"g{g}cut"] == "cut by its copy" for g in range(6))


def test_field_limits(spark):
    """Lengths that many undecided texts share are limits, wherever sentences could end there."""
    shares = truncation._shares(pa.table({"role": ["a"] * 2, "kind": ["k"] * 2, "bin": [40, -40], "n": [900, 100]}))
    assert abs(shares.column("share")[0].as_py() - 0.9) < 0.01


def test_open_blocks():
    assert truncation.judge("see\n```py\nx = 1") == "cut" and truncation.judge("see\n```py\nx = 1\n```") == "complete"
    assert truncation.kind("so the ") == "blank" and truncation.kind("so the...") == "dots"


# --- 6 --------------------------------------------------------------------------------


@given(st.lists(st.lists(st.sampled_from([0, 1, 2]), max_size=5), max_size=5))
def test_slices_combine_to_the_whole(slices):
    """What verdicts() computes from summaries equals one pass over all roles."""
    flat = [w for s in slices for w in s]
    whole = conversations.summary(flat)
    parts = [conversations.summary(s) for s in slices if s]
    bad, pending = False, False
    for n, user, answer_first, asks, open_, broken in parts:
        if pending and (asks or answer_first):
            bad |= not answer_first
            pending = False
        bad |= broken
        pending = open_ or (pending and not asks and not answer_first)
    assert (bad or pending) == (whole[5] or whole[4])


def test_conversations(spark, tmp_path):
    h, t0 = 3_600_000, 1_700_000_000_000
    rows = [
        # sound over two slices, a late row, seconds for one time, a second delivery
        ("a1", "A", "User", "hi", t0 + 10 * h, 0), ("a2", "A", " assistant ", "yo", t0 + 10 * h + 1, 5), ("a3", "A", "user", "q", (t0 + 17 * h) // 1000, 2), ("a4", "A", "toolResult", "t", t0 + 17 * h + 1, 3),
        ("a5", "A", "assistant", "z", t0 + 30 * h, 4), ("a5", "A", "assistant", "z", t0 + 30 * h, 4),
        ("b1", "B", "assistant", "hi", 1, 0), ("b2", "B", "user", "q", 2, 1), ("b3", "B", "assistant", "r", 3, 2),
        ("c1", "C", "user", "q", t0 + 5 * h, 0), ("c2", "C", "user", "q", t0 + 9 * h, 1), ("c3", "C", "assistant", "r", t0 + 10 * h, 2),
        ("d1", "D", "user", None, 1, 0), ("d2", "D", "assistant", " \t", 2, 0),
        ("e1", "E", "user", "q", 5, 1), ("e2", "E", "assistant", "r", 5, 2), ("f1", "F", "user", "q", None, None),
        ("x1", None, "user", "q", 1, 1), ("x2", "unknown", "user", "q", 1, 1), ("g1", "G", "user", "q", 9_999_999_999_999_999, 1), ("g2", "G", "assistant", "q", 9_999_999_999_999_999, 2),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "unit_id string, session_id string, role string, text string, ts_ms long, seq long, slice int")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    closed = conversations.rebuild(spark, str(tmp_path / "t"), with_messages=True)
    got = {r["session_id"]: (r["messages"], r["reason"]) for r in conversations.verdicts(closed).collect()}
    assert got == {"A": (5, None), "B": (3, "no opening"), "C": (3, "no reply"), "D": (0, "empty"), "E": (2, None), "F": (1, "no reply"), "G": (2, None)}
    order = [r["unit_id"] for r in closed.where("session_id = 'A' AND place > 0").orderBy("slice", "place").collect()]
    assert order == ["a1", "a2", "a3", "a4", "a5"]
    spark.createDataFrame([], df.schema).write.parquet(str(tmp_path / "e"))
    assert conversations.verdicts(conversations.rebuild(spark, str(tmp_path / "e"))).count() == 0


def test_running_stream_with_late_messages(spark, tmp_path):
    """Late messages within the lateness join their slice, later ones are dropped and counted, repeated ones count once."""
    h, t0 = 3_600_000, 1_699_999_200_000
    columns = "unit_id string, session_id string, role string, text string, ts_ms long, seq long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(source)
        slim = conversations.messages(spark.readStream.schema(columns).parquet(source), 1, 6 * h)
        closed = conversations.conversation_stream(slim, lateness_ms=24 * h, slice_ms=6 * h, with_messages=True)
        query = closed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination()
        return conversations.dropped_late(query.recentProgress)

    assert arrive(("a1", "A", "user", "q", t0, 0), ("a2", "A", "assistant", "r", t0 + 1, 1)) == 0
    # hours late, and a repeated delivery
    assert arrive(("b1", "B", "user", "q", t0 + 20 * h, 5), ("a0", "A", "user", "first", t0 - 1, 2), ("a2", "A", "assistant", "r", t0 + 1, 1)) == 0
    arrive(("c1", "C", "user", "q", t0 + 90 * h, 6))
    # the slice of A has closed
    assert arrive(("a9", "A", "user", "days late", t0 + 5, 7), ("c2", "C", "assistant", "r", t0 + 91 * h, 8)) == 1
    arrive(("d1", "D", "user", "q", t0 + 900 * h, 9))
    closed = spark.read.schema(conversations.EMITTED).parquet(out)
    assert [r["unit_id"] for r in closed.where("session_id = 'A' AND place > 0").orderBy("slice", "place").collect()] == ["a0", "a1", "a2"]
    assert {r["session_id"]: r["reason"] for r in conversations.verdicts(closed).collect()} == {"A": "no reply", "B": "no reply", "C": None}


# --- 8 -----------------------------------------------------------------------------------


@given(st.lists(st.integers(1, 100), max_size=300), st.integers(1, 8))
def test_open_containers(sizes, limit):
    closed = []
    held = packing.OpenContainers(100, limit, lambda m, used: closed.append((m, used)))
    for i, s in enumerate(sizes):
        held.place(i, s)
        assert len(held.free) <= limit
    closed += list(held.leftovers())
    assert sorted(i for m, _ in closed for i in m) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in m) == used <= 100 for m, used in closed)


def test_packing_documents(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(1, 120, 200)] + [None, "", " ".join(["word"] * 1000)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(0, texts[0], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item int").repartition(5)
    got = packing.packed_documents(df, capacity=128).collect()
    space: dict = {}
    whole: dict = {}
    for r in got:
        space[r["container"]] = space.get(r["container"], 0) + r["n_tokens"]
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["n_tokens"]
    assert max(space.values()) <= 128
    assert whole == {i: tokens.count(t) for i, t in enumerate(texts) if t}
    assert {r["doc_id"] for r in got if r["n_pieces"] > 1} == {i for i, t in enumerate(texts) if t and tokens.count(t) > 128}
    least = -(-sum(whole.values()) // 128)
    assert len(space) <= least * 1.1 + 1
    assert packing.packed_documents(df.limit(0)).count() == 0


def test_segments_keep_the_tokens():
    text = "alpha  beta\n gamma delta " * 40
    encode = tokens.encoding().encode_ordinary
    parts = list(tokens.segments(text, 100))
    assert "".join(parts) == text and len(parts) > 5
    assert [t for p in parts for t in encode(p)] == encode(text)
    # runs are never cut, and cuts fall only where a run ends
    for text in ("a" * 500 + "1" * 300 + "=" * 700 + " x'll 9é́ß\n\n  " * 30, "=" * 900, "日本語" * 200 + "１２３" * 50 + " end"):
        parts = list(tokens.segments(text, 60))
        assert "".join(parts) == text and [t for p in parts for t in encode(p)] == encode(text)


# --- 9 -----------------------------------------------------------------------------------------


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 40)
    rows = [(i, "word " * 20, " Big" if i % 2 else "big", 1) for i in range(300)] + [(1000 + i, "word " * 20, "small", 1) for i in range(20)]
    rows += [(2000, None, "big", 1), (2001, "word " * 100, None, 1), (0, "word " * 20, "big", 1), (None, "x", "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, total int")
    targets = spark.createDataFrame([("BIG ", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, plan = mixing.mixture(docs, targets)
    used = mixed.collect()
    report = {r["source"]: r for r in mixing.mix_report(mixed, plan).collect()}
    assert [r["position"] for r in used] == sorted(r["position"] for r in used) and 0 <= used[0]["position"] and used[-1]["position"] <= 1
    assert report["none"]["short"] and report["none"]["uses"] == 0
    assert report["small"]["short"] and report["small"]["uses"] == 60
    budget = plan.first()["budget"]
    assert not report["big"]["short"] and abs(report["big"]["used_tokens"] - 0.6 * budget) <= 25
    copies: dict = {}
    for r in used:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies[d] for d in copies if d < 1000) == 1 and max(copies.values()) == 3
    mixed, plan = mixing.mixture(docs, targets, policy="shrink")
    even = {r["source"]: r for r in mixing.mix_report(mixed, plan).collect()}
    assert abs(even["big"]["actual_share"] - 2 / 3) < 0.01 and abs(even["small"]["actual_share"] - 1 / 3) < 0.01 and even["none"]["uses"] == 0
    empty, plan = mixing.mixture(docs.limit(0), targets)
    assert empty.count() == 0 and {r["used_tokens"] for r in mixing.mix_report(empty, plan).collect()} == {0}


# --- 10 ---------------------------------------------------------------------------------------------


def _document(rng, level):
    easy, hard = "cat dog sun run big red box day map hat".split(), "institutional heterogeneous approximation configuration methodological reproducibility".split()
    out = []
    for _ in range(12):
        n = 4 + 4 * level
        out.append("The " + " ".join(str(rng.choice(hard if rng.random() < 0.25 * (level - 0.7) else easy)) for _ in range(n)) + ".")
    return " ".join(out)


def test_reading_levels(spark):
    rng = np.random.default_rng(6)
    levels = [int(x) for x in rng.integers(1, 5, 400)]
    docs = [(i, _document(rng, lv), 1) for i, lv in enumerate(levels)]
    labels = [(i, lv, "a") for i, lv in enumerate(levels[:250])] + [(3, None, "b"), (None, 2, "b")]
    log = "2025-01-24 02:41:39.882 INFO [x-1] job loads the thing in 20 ms\n" * 20
    docs += [(900, None, 1), (901, "  ", 1), (902, log, 1), (903, "a | 1 | b\nc | 2 | d\n" * 9, 1), (904, "n/a", 1), (905, "# Head\n" + docs[0][1], 1), (0, docs[0][1], 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, level int")
    lab = spark.createDataFrame(labels, "doc_id long, reading_level int, rater string")
    got = {r["doc_id"]: r["level"] for r in reading.reading_levels(df, lab).collect()}
    assert not set(got) & {900, 901, 902, 903, 904} and 905 in got and len(got) == 401
    held = range(250, 400)
    assert np.mean([got[i] == levels[i] for i in held]) >= 0.8
    assert reading.reading_levels(df, lab.limit(0)).count() == 0
    assert reading.reading_levels(df.limit(0), lab).count() == 0


def test_isotonic():
    x, y = reading.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 3, 2, 2, 5]))
    fitted = reading.predict((x, y), np.array([1.0, 2, 3, 4, 5]))
    assert list(np.diff(fitted) >= 0) == [True] * 4 and fitted[0] == 1 and fitted[4] == 5 and fitted[2] == pytest.approx(7 / 3)


def test_reading_levels_are_fitted_on_all_labels(spark):
    """Words of every labelled document are counted, however many documents there are."""
    word = lambda i: "q" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    docs = [(i, f"{word(i)} and {word(i)} are " + " ".join(["words that stand in a plain line of text"] * 2) + ".") for i in range(8_100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    grader = reading.fit(df, spark.createDataFrame([(i, 1 + i % 4) for i in range(8_100)], "doc_id long, reading_level int"))
    assert all(word(i) in grader.vocabulary for i in range(8_100))


def test_fitting_reading_levels_brings_no_document_to_the_driver(spark, monkeypatch):
    """What the driver gets follows the different words and trigrams, not the labelled documents; all of these are counted."""
    rng = np.random.default_rng(7)
    texts = [_document(rng, 1 + i % 4) for i in range(60)]
    frame, got = type(spark.range(1)), []
    for name in ("toArrow", "collect"):
        monkeypatch.setattr(frame, name, lambda df, f=getattr(frame, name): (got.append(f(df)), got[-1])[1])
    fetched = []
    for copies in (2, 20):
        got.clear()
        df = spark.createDataFrame([(60 * k + i, t) for k in range(copies) for i, t in enumerate(texts)], "doc_id long, text string")
        grader = reading.fit(df, df.select("doc_id", (1 + F.col("doc_id") % 4).cast("int").alias("reading_level")))
        fetched.append(sum(t.nbytes if isinstance(t, pa.Table) else len(str(t)) for t in got))
        assert grader.easy.total == copies * sum(len(reading.prose(t)) for t in texts[::4])
        assert grader.hard.total == copies * sum(len(reading.prose(t)) for t in texts[3::4])
    assert fetched[1] < 1.5 * fetched[0]
