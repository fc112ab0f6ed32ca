"""Scalars against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from spoor.functions import text as T
from spoor.functions import vectors as V


def one(spark, column, **values):
    types = {"text": "string", "q": "string", "v": "array<double>", "w": "array<double>", "ts": "long", "a": "array<string>", "b": "array<string>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[k]}" for k in values))
    return df.select(column.alias("x")).first()["x"]


def fingerprint(text):
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    norm, h = " ".join(words)[:500], 5381
    for c in norm:
        h = ((h * 33) % 2**32) ^ ord(c)
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while h:
        h, r = divmod(h, 36)
        out = digits[r] + out
    return out or "0"


@pytest.mark.parametrize("text", ["Hello, World!", "", "a" * 900, "Ünï cödé  x", "A-B_c 9"])
def test_fingerprint(spark, text):
    assert one(spark, T.fingerprint(F.col("text")), text=text) == fingerprint(text)
    assert one(spark, T.fingerprint(F.col("text")), text=text.upper() + "!!") == fingerprint(text.upper())


def test_tokens_and_entities(spark):
    assert one(spark, T.tokens(F.col("text")), text="The Cache_2 runs: a b9 x the cache_2") == ["cache_2", "b9", "cache_2"]
    assert one(spark, T.tokens(F.col("text")), text=None) == []
    found = one(spark, T.entities(F.col("text")), text='see src/lib/x.ts and `do it` or "Big Name", FooBar, éabc_def, a_b, HTTP2, 12.5.7 HTTP2')
    assert found == ["src/lib/x.ts", "12.5.7", "do it", "big name", "foobar", "abc_def", "a_b", "http2"]
    many = " ".join(f"name_{chr(97 + i)}x" for i in range(20))
    assert len(one(spark, T.entities(F.col("text")), text=many)) == T.MAX_ENTITIES


@pytest.mark.parametrize("age, want", [(0, "1s ago"), (59_000, "59s ago"), (60_000, "1m ago"), (7_200_000, "2h ago"), (6 * 86_400_000, "6d ago"), (7 * 86_400_000, "2023-11-07")])
def test_relative_time(spark, age, want):
    now = 1_700_000_000_000
    assert one(spark, T.rel_time(F.col("ts"), F.lit(now)), ts=now - age) == want


def test_snippet_and_fences(spark):
    text = "# Head\n- item\n> quote\n```py\nx\n```"
    assert one(spark, T.snippet(F.col("text"), 100), text=text) == "Head item quote '''py x '''"
    assert one(spark, T.snippet(F.col("text"), 6), text="abcde fghi") == "abcde…"
    assert one(spark, T.strip_fences(F.col("text")), text='```json\n{"a": 1}\n```') == '{"a": 1}'


@pytest.mark.parametrize("q, ents, toks, want", [("get key_x", 1, 3, 0.25), ("give me an overview", 0, 2, 0.7), ("w " * 14, 0, 14, 0.6), ("plain words here", 0, 8, 0.5), ("plain", 2, 8, 0.4)])
def test_lambda(spark, q, ents, toks, want):
    assert one(spark, T.mmr_lambda(F.col("q"), F.lit(ents), F.lit(toks)), q=q) == want


@pytest.mark.parametrize("q, text, want", [("when was it", "on 3 May", 1), ("when was it", "no idea", 0), ("how many are left", "7 left", 1), ("how many", "x7y", 0), ("who", "7", 0)])
def test_type_compat(spark, q, text, want):
    assert one(spark, T.type_compat(F.col("q"), F.col("text")), q=q, text=text) == want


def test_min_max_is_not_clamped(spark):
    value = lambda v, lo, hi: one(spark, T.min_max(F.lit(v), F.lit(lo), F.lit(hi)), text="")
    assert value(0.0, 1.0, 3.0) == -0.5 and value(2.0, 2.0, 2.0) == 1.0 and value(0.0, 0.0, 0.0) == 0.0


def test_quantize_halves_and_zero(spark):
    q = one(spark, V.quantize(F.col("v")), v=[1.0, -0.5 / 127, 0.5 / 127, -1.0])
    assert q["q"] == [127, 0, 1, -127] and q["scale"] == 1.0
    assert one(spark, V.quantize(F.col("v")), v=[0.0, 0.0])["q"] == [0, 0]
    back = one(spark, V.dequantize(F.lit(5.0), F.array(F.lit(127), F.lit(0)).cast("array<tinyint>")), text="")
    assert back == [1.0, 0.0]
    assert one(spark, V.cosine(F.col("v"), F.col("w")), v=[1.0, 0.0], w=[0.0, 0.0]) == 0.0
    assert one(spark, V.cosine(F.col("v"), F.col("w")), v=[3.0, 4.0], w=[4.0, 3.0]) == pytest.approx(24 / 25)
    assert one(spark, V.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert math.isclose(one(spark, V.jaccard(F.col("a"), F.col("b")), a=[], b=[]), 0.0)
