"""Problem 10: the reading level of each document.

Method: interpolated trigram models of the easiest and of the hardest labelled
prose, in all languages at once, give every word of a document its surprisal
under both. The weights of their orders are fitted by expectation maximisation
on labelled prose that the counts have not seen. What measures a document is
the distribution, over all its words, of the difference of the two surprisals
(mean, spread, five quantiles) and of the lower of the two (mean, upper decile, sum by sentence,
words by sentence). A ridge regression on the labels makes one number of these, and
isotonic regression maps it to the graded scale, by language where that has
enough labels. Models and maps are fitted on all labelled documents, whole; maps on
surprisals under models that have not seen the document. Words, trigrams, moments of the measures and
blocks of equal levels are counted in the tasks; the driver gets the sums, no prose and no row of a document. Models
go to every task, so memory grows with the different words and trigrams of labelled documents.
All documents are scored, whole, in one narrow pass.

Defined results
* null and blank texts, logs, tables and code alone are no running prose and
  have no row: a document needs ``LEAST_WORDS`` words outside of these;
* raters' levels of a document are averaged, null levels left out;
* the language is read off the text itself, not off a column;
* without any label there is no scale and no row;
* repeated rows of a document give one row; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.runtime import load, materialize, swept

#: Labels of a language that make a map of its own.
OWN_MAP = 120
#: Words of prose that make a document.
LEAST_WORDS = 10
#: Documents measured together, and words whose weights are fitted together.
TOGETHER, WORDS_TOGETHER = 1_000, 1 << 18
#: Rounds in which the weights of trigram, bigram, unigram and uniform estimates are fitted.
WEIGHT_ROUNDS = 30
#: Bits to which the difference of one word is held, so that no rare word outweighs a sentence.
HELD = 2.0

#: Quantiles of the differences that measure a document.
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Penalty on the squared coefficients of the standardised measures.
RIDGE = 5.0

#: Frequent function words that tell the languages apart (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in that is for with as are this by on or be not from at it".split(),
    "de": "die der und das den von zu mit des auf ist im dem nicht ein eine als auch es an".split(),
    "fr": "les des et le la une du en que pour dans est par sur pas plus au avec ce sont".split(),
    "es": "los las el y del que una por con para es un se no al lo como más sus son".split(),
}
_LANGUAGE = {w: code for code, words in FUNCTION_WORDS.items() for w in words}

_FENCE = re.compile(r"(?ms)^\s*(```|~~~).*?(?:^\s*\1\s*$|\Z)")
_LOG = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|^\s*(?:TRACE|DEBUG|INFO|WARN|ERROR)\b|^\s*\[(?:tool|result)")
_BULLET = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)])\s+")
_TAG = re.compile(r"<[^<>\n]{1,200}>")
_TICKS = re.compile(r"`[^`\n]*`")
_NAME = re.compile(r"\w*[_/\\]\w[\w./\\]*")
_DOTTED = re.compile(r"\b\w+\.\w{2,4}\b(?!\s+[A-ZÄÖÜ])")
_SHORT = re.compile(r"(?i)\b(?:cf|e\.g|i\.e|v|vs|etc|z\.b|d\.h|bzw|vgl|p\. ?ex|p\. ?ej|nr|no|dr|mr|mrs|ms|prof|sr|sra)\.")
_SHORT_HINT = re.compile(r"\b\w{1,4}\.(?=\w|\s[^A-ZÄÖÜ])")
_DIGIT = re.compile(r"\d")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?]+(?=\s|$)|[;:,]")


def prose(text: str | None) -> list[str]:
    """The words and marks of a text's running prose; sentences end in a full stop."""
    if not text or not text.strip():
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    out: list[str] = []
    found = 0
    for line in text.split("\n"):
        line = line.strip()
        if not line or line.startswith("#") or line.count("|") >= 2 or line.count("\t") >= 2 or _LOG.match(line):
            continue
        listed = _BULLET.match(line)
        if listed:
            line = line[listed.end() :]
        if "<" in line:
            line = _TAG.sub(" ", line)
        if "`" in line:
            line = _TICKS.sub(" ", line)
        if "_" in line or "/" in line or "\\" in line:
            line = _NAME.sub(" ", line)
        if _SHORT_HINT.search(line):
            line = _SHORT.sub(" ", _DOTTED.sub(" ", line))
        tokens = _TOKEN.findall(line)
        words = sum([t[0].isalpha() for t in tokens])
        if words < 3 or len(_DIGIT.findall(line)) * 5 > len(line):
            continue
        found += words
        for t in tokens:
            if t[0] in ".!?":
                out.append(".")
                continue
            word = t.lower()
            if t != word and word in _LANGUAGE and out and out[-1].isalpha() and len(t) > 1:
                out.append(".")  # a sentence begins though the one before has no mark
            out.append(word)
        if listed and out[-1] != ".":
            out.append(".")
    return out if found >= LEAST_WORDS else []


def language(tokens: list[str]) -> str:
    """The language most of whose function words occur; '' if none does."""
    seen = dict.fromkeys(FUNCTION_WORDS, 0)
    for t in tokens:
        code = _LANGUAGE.get(t)
        if code:
            seen[code] += 1
    best = max(seen, key=lambda c: seen[c])
    return best if seen[best] else ""


@dataclass
class Model:
    """Interpolated trigram counts over word numbers, as sorted keys."""

    keys: list[np.ndarray]
    counts: list[np.ndarray]
    words: int
    total: int
    #: Of trigram, bigram, unigram and uniform estimates.
    weights: np.ndarray = field(default_factory=lambda: np.full(4, 0.25))

    @classmethod
    def of(cls, trigrams: np.ndarray, counts: np.ndarray, words: int) -> Model:
        """From different trigrams and how often each occurs; each word ends one, so they say all of the shorter ones."""
        keys, held = [], []
        for key in _shorter(trigrams, words)[::-1]:
            k, inverse = np.unique(key, return_inverse=True)
            keys.append(k), held.append(np.bincount(inverse, counts, len(k)))
        return cls(keys, held, words, int(counts.sum()))

    def _count(self, order: int, key: np.ndarray) -> np.ndarray:
        keys, counts = self.keys[order], self.counts[order]
        if not len(keys):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, counts[at], 0.0)

    def _context(self, order: int, key: np.ndarray) -> np.ndarray:
        """Occurrences of the context (all but the last word) of n-grams of this order."""
        if order == 0:
            return np.full(len(key), max(1, self.total), "f8")
        if not hasattr(self, "_held"):
            self._held = {}
        if order not in self._held:
            k, inverse = np.unique(self.keys[order] // self.words, return_inverse=True)
            self._held[order] = (k, np.bincount(inverse, self.counts[order]) if len(k) else np.empty(0))
        k, n = self._held[order]
        if not len(k):
            return np.zeros(len(key))
        c = key // self.words
        at = np.minimum(np.searchsorted(k, c), len(k) - 1)
        return np.where(k[at] == c, n[at], 0.0)

    def estimates(self, trigrams: np.ndarray) -> np.ndarray:
        """The trigram, bigram, unigram and uniform estimate (rows) of the last word of each trigram."""
        out = []
        for order, key in zip((2, 1, 0), _shorter(trigrams, self.words)):
            n = self._context(order, key)
            out.append(np.divide(self._count(order, key), n, out=np.zeros(len(key)), where=n > 0))
        return np.array([*out, np.full(len(trigrams), 1 / self.words)])

    def surprisal(self, trigrams: np.ndarray) -> np.ndarray:
        return -np.log2(self.weights @ self.estimates(trigrams))

    def fit_weights(self, trigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Interpolation weights under which the unseen ``trigrams``, each so often, are likeliest."""
        w = np.full(4, 0.25)
        if len(trigrams):
            p = self.estimates(trigrams)
            for _ in range(WEIGHT_ROUNDS):
                total = np.zeros(4)
                for at in range(0, len(trigrams), WORDS_TOGETHER):
                    q = w[:, None] * p[:, at : at + WORDS_TOGETHER]
                    total += (q / q.sum(axis=0)) @ counts[at : at + WORDS_TOGETHER]
                w = total / counts.sum()
        return np.maximum(w, 1e-4) / np.maximum(w, 1e-4).sum()


def _trigrams(s: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """Keys of the trigrams that end at each place of documents in a row; 0 stands before the first word of each."""
    s = s.astype("i8")
    v = np.r_[0, s[:-1]] if len(s) else s
    v[starts] = 0
    u = np.r_[0, v[:-1]] if len(s) else s
    u[starts] = 0
    return (u * words + v) * words + s


def _shorter(trigrams: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of trigrams, of the bigrams that end them and of their last words."""
    return trigrams, trigrams % (words * words), trigrams % words


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x, fitted y), not decreasing."""
    at, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    return _knots(_pooled(zip(np.bincount(inverse, y, len(at)), n, at, at)))


def _pooled(parts) -> list[list[float]]:
    """Blocks [sum, count, first x, last x] of growing mean from such blocks by growing x; blocks of parts pool to those of the whole."""
    blocks: list[list[float]] = []
    for part in parts:
        blocks.append([float(v) for v in part])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    return blocks


def _knots(blocks: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    knots, fitted = [], []
    for s, n, first, last in blocks:
        knots += [first, last] if last > first else [first]
        fitted += [s / n] * (2 if last > first else 1)
    return np.array(knots), np.array(fitted)


def predict(curve: tuple[np.ndarray, np.ndarray], x) -> np.ndarray:
    return np.interp(x, *curve)


def _joined(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents in a row, and where each begins."""
    sizes = np.array([len(d) for d in documents], "i8")
    return np.concatenate(documents) if documents else np.empty(0, "i8"), np.cumsum(sizes) - sizes


@dataclass
class Grader:
    """Fitted models and maps; ``grade_all`` measures and grades documents given as tokens."""

    vocabulary: dict[str, int]
    #: Of the easiest and of the hardest prose.
    easy: Model | None = None
    hard: Model | None = None
    #: (mean, spread, coefficients, curve) that take measures to the graded scale, by language; '' is all.
    maps: dict[str, tuple] = field(default_factory=dict)

    @classmethod
    def over(cls, words: list[str]) -> Grader:
        """Without models, over the words seen more than once."""
        # 0 is the border of a document, 1..8 words seen once or never, by length
        return cls({w: i + 9 for i, w in enumerate(sorted(words))})

    @property
    def words(self) -> int:
        return len(self.vocabulary) + 9

    def code(self, tokens: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(t) or 1 + min(7, len(t) // 3) for t in tokens], "i8")

    def measure(self, documents: list[np.ndarray]) -> np.ndarray:
        """A row of measures of each of many coded documents, none empty."""
        s, starts = _joined(documents)
        sizes = np.array([len(d) for d in documents])
        seen, at = np.unique(_trigrams(s, starts, self.words), return_inverse=True)
        e, h = self.easy.surprisal(seen)[at], self.hard.surprisal(seen)[at]
        low, d = np.minimum(e, h), np.clip(e - h, -HELD, HELD)
        of = np.repeat(np.arange(len(sizes)), sizes)
        mean = np.add.reduceat(d, starts) / sizes
        spread = np.sqrt(np.maximum(0, np.add.reduceat(d * d, starts) / sizes - mean * mean))
        stops = np.maximum(1, np.add.reduceat((s == self.vocabulary.get(".", -1)).astype("i8"), starts))
        total = np.add.reduceat(low, starts)

        def quantiles(x: np.ndarray, *wanted: float) -> list[np.ndarray]:
            ranked = x[np.lexsort((x, of))]
            out = []
            for q in wanted:
                at = q * (sizes - 1)
                a = np.floor(at).astype("i8")
                b = np.minimum(a + 1, sizes - 1)
                out.append(ranked[starts + a] + (at - a) * (ranked[starts + b] - ranked[starts + a]))
            return out

        columns = [mean, spread, *quantiles(d, *QUANTILES), total / sizes, *quantiles(low, 0.9), np.log2(total / stops + 1e-9), np.log2(sizes / stops)]
        return np.stack(columns, axis=1)

    def grade_all(self, documents: list[list[str]]) -> list[tuple]:
        """(language, level, mean, median, upper decile) of each of many documents, none empty."""
        x = self.measure([self.code(t) for t in documents])
        codes = [language(t) for t in documents]
        used = np.array([c if c in self.maps else "" for c in codes], object)
        levels = np.zeros(len(x))
        for code in set(used):
            mean, spread, w, curve = self.maps[code]
            rows = np.flatnonzero(used == code)
            levels[rows] = predict(curve, ((x[rows] - mean) / spread) @ w)
        levels = np.clip(np.floor(levels + 0.5), 1, 4).astype(int)
        median, upper = 2 + QUANTILES.index(0.5), 2 + QUANTILES.index(0.9)
        return list(zip(codes, levels.tolist(), x[:, 0].tolist(), x[:, median].tolist(), x[:, upper].tolist()))


def _numbered(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(y, half, prose) of the labelled documents of running prose, in two halves that take turns by doc_id."""
    rated = labels.where(F.col("reading_level").between(1, 4) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("reading_level").alias("y"))
    texts = documents.select("doc_id", "text").join(F.broadcast(rated), "doc_id").dropDuplicates(["doc_id"])
    kind = dict(texts.dtypes)["doc_id"]

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([" ".join(prose(t)) for t in batch.column(2).to_pylist()])],
                names=["doc_id", "y", "prose"],
            )

    def number(batches):
        part, i = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, "i4")), pa.array((np.arange(i, i + n) % 2).astype("i4")), batch.column(1), batch.column(2)], names=["part", "i", "y", "prose"]
            )
            i += n

    rows = materialize(texts.select("doc_id", "y", "text").mapInArrow(read, f"doc_id {kind}, y double, prose string").where("prose <> ''"), "reading-prose")
    rows = materialize(rows.orderBy("doc_id").mapInArrow(number, "part int, i int, y double, prose string"), "reading-numbered")
    sizes = sorted(rows.groupBy("part").count().collect())
    odd = [p for (p, _), before in zip(sizes, np.cumsum([0, *(n for _, n in sizes)])) if before % 2]
    return rows.select("y", F.when(F.col("part").isin(odd), 1 - F.col("i")).otherwise(F.col("i")).alias("half"), "prose")


def _words(prose_rows: DataFrame) -> list[str]:
    """The words that occur more than once."""

    def count(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(text.as_py().split(" "))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    seen = prose_rows.select("prose").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return seen.where("n > 1").select("word").toArrow().column("word").to_pylist()


def _split(batch: pa.RecordBatch) -> list[list[str]]:
    return [t.split(" ") for t in batch.column("prose").to_pylist()]


def _counted(rows: DataFrame, grader: Grader) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By (half, hard): the different trigrams of the easiest or hardest documents of a half, and how often each occurs."""
    held = rows.sparkSession.sparkContext.broadcast(grader)

    def count(batches):
        g = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                which = batch.column("half").to_numpy() + 2 * (batch.column("y").to_numpy() >= 3.5)
                documents = [g.code(t) for t in _split(batch)]
                for k in set(which.tolist()):
                    key, n = np.unique(_trigrams(*_joined([d for d, w in zip(documents, which) if w == k]), g.words), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, "i4")), pa.array(key), pa.array(n)], names=["which", "trigram", "n"])

    counts = rows.where("y < 1.5 or y >= 3.5").mapInArrow(count, "which int, trigram long, n long").groupBy("which", "trigram").agg(F.sum("n").alias("n"))
    got = counts.orderBy("which", "trigram").toArrow()
    which, key, n = (got.column(c).to_numpy() for c in ("which", "trigram", "n"))
    return {(k % 2, k // 2): (key[which == k], n[which == k].astype("f8")) for k in range(4)}


def _sums(measured: DataFrame, centres: dict[str, np.ndarray] | None = None) -> dict[str, tuple[int, np.ndarray]]:
    """By language ('' is all): rows, and sums of (measures, y), or of the products of these less ``centres``."""

    def add(batches):
        total: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.array(batch.column("lang").to_pylist(), object)
            z = np.column_stack([np.array(batch.column("x").to_pylist(), "f8"), batch.column("y").to_numpy()])
            for code in {"", *of} if centres is None else centres:
                part = z[of == code] if code else z
                held = total.setdefault(code, [0, 0.0])
                held[0] += len(part)
                held[1] = held[1] + (part.sum(axis=0) if centres is None else ((part - centres[code]).T @ (part - centres[code])).ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([v.tolist() for _, v in total.values()], pa.list_(pa.float64()))], names=["code", "n", "v"]
        )

    out: dict[str, tuple[int, np.ndarray]] = {}
    for code, n, v in measured.mapInArrow(add, "code string, n long, v array<double>").collect():
        m, w = out.get(code, (0, 0.0))
        out[code] = (m + n, w + np.array(v))
    return out


def _maps(measured: DataFrame) -> dict[str, tuple]:
    """(mean, spread, coefficients, curve) by language from (lang, y, x), for languages of enough labels; '' is all."""
    centres = {code: v / n for code, (n, v) in _sums(measured).items() if n >= (OWN_MAP if code else 1)}
    linear = {}
    for code, (n, v) in _sums(measured, centres).items():
        products, mean = v.reshape(len(centres[code]), -1), centres[code][:-1]
        spread = np.sqrt(np.diag(products)[:-1] / n) + 1e-9
        w = np.linalg.solve(products[:-1, :-1] / np.outer(spread, spread) + RIDGE * np.eye(len(spread)), products[:-1, -1] / spread)
        linear[code] = (mean, spread, w)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            of, y = np.array(batch.column("lang").to_pylist(), object), batch.column("y").to_numpy()
            x = np.array(batch.column("x").to_pylist(), "f8")
            for code, (mean, spread, w) in linear.items():
                rows = np.flatnonzero(of == code) if code else np.arange(len(y))
                yield pa.RecordBatch.from_arrays([pa.array([code] * len(rows), pa.string()), pa.array(((x[rows] - mean) / spread) @ w), pa.array(y[rows])], names=["code", "x", "y"])

    def pool(batches):
        held: dict[str, list] = {}
        for batch in batches:
            code = np.array(batch.column("code").to_pylist(), object)
            x, s, n = (batch.column(c).to_numpy() for c in ("x", "s", "n"))
            for c in sorted(set(code)):
                at = code == c
                held[c] = _pooled([*held.get(c, []), *zip(s[at], n[at], x[at], x[at])])
        for c, blocks in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(blocks), pa.string()), *(pa.array(v, pa.float64()) for v in zip(*blocks))], names=["code", "s", "n", "first", "last"])

    # what has the same place is one block from the start, so the blocks are the same however the places are split
    places = measured.mapInArrow(place, "code string, x double, y double").groupBy("code", "x").agg(F.sum("y").alias("s"), F.count("*").cast("double").alias("n"))
    blocks: dict[str, list] = {}
    for code, *block in sorted(places.orderBy("code", "x").mapInArrow(pool, "code string, s double, n double, first double, last double").collect(), key=lambda r: (r[0], r[3])):
        blocks.setdefault(code, []).append(block)
    return {code: (*parts, _knots(_pooled(blocks[code]))) for code, parts in linear.items()}


def fit(documents: DataFrame, labels: DataFrame) -> Grader | None:
    """A grader from all labelled documents."""
    with swept(documents.sparkSession):
        return _fitted(documents, labels)


def _fitted(documents: DataFrame, labels: DataFrame) -> Grader | None:
    rows = _numbered(documents, labels)
    if rows.isEmpty():
        return None
    grader = Grader.over(_words(rows))
    counts = _counted(rows, grader)
    models = [[Model.of(*counts[half, hard], grader.words) for hard in (0, 1)] for half in (0, 1)]
    weights = []
    for train, held in ((0, 1), (1, 0)):
        for hard, model in enumerate(models[train]):
            model.weights = model.fit_weights(*counts[held, hard])
        weights.append([m.weights for m in models[train]])
    # a document is measured by the models of the other half
    halves = rows.sparkSession.sparkContext.broadcast([Grader(grader.vocabulary, *models[1 - half]) for half in (0, 1)])

    def measure(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                tokens, half, y = _split(batch), batch.column("half").to_numpy(), batch.column("y").to_numpy()
                for k in (0, 1):
                    at = np.flatnonzero(half == k)
                    if len(at):
                        g = halves.value[k]
                        x = g.measure([g.code(tokens[i]) for i in at])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([language(tokens[i]) for i in at], pa.string()), pa.array(y[at]), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["lang", "y", "x"]
                        )

    measured = materialize(rows.mapInArrow(measure, "lang string, y double, x array<double>"), "reading-measures")
    merged = [(np.concatenate([counts[half, hard][0] for half in (0, 1)]), np.concatenate([counts[half, hard][1] for half in (0, 1)])) for hard in (0, 1)]
    grader.easy, grader.hard = (Model.of(*m, grader.words) for m in merged)
    grader.easy.weights, grader.hard.weights = (np.mean([w[i] for w in weights], axis=0) for i in (0, 1))
    grader.maps = _maps(measured)
    return grader


_GRADED = "lang string, level int, mean double, median double, upper double"


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, level, mean, median, upper) of each document of running prose.

    ``mean``, ``median`` and ``upper`` (the upper decile) are of the surprisal
    differences of its words, in bits.
    """
    kind = dict(documents.dtypes)["doc_id"]
    grader = fit(documents, labels)
    if grader is None:
        return documents.sparkSession.createDataFrame([], f"doc_id {kind}, {_GRADED}")
    held = documents.sparkSession.sparkContext.broadcast(grader)

    def score(batches):
        g = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                read = [prose(t) for t in batch.column(1).to_pylist()]
                at = [i for i, tokens in enumerate(read) if tokens]
                if not at:
                    continue
                columns = zip(*g.grade_all([read[i] for i in at]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64())))],
                    names=["doc_id", "lang", "level", "mean", "median", "upper"],
                )

    src = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string"))
    return src.mapInArrow(score, f"doc_id {kind}, {_GRADED}").dropDuplicates(["doc_id"])


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(load(spark, sf_dir, "documents"), load(spark, sf_dir, "reading_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level, from 1 to 4, of each document of running prose."""
    return _levels(spark, sf_dir).select("doc_id", "level")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and mean surprisal difference by language and level."""
    levels = _levels(spark, sf_dir)
    return levels.groupBy("lang", "level").agg(F.count("*").alias("documents"), F.round(F.avg("mean"), 3).alias("mean_bits"))


QUERIES = {"p10_found": p10_found, "p10_profile": p10_profile}
ORACLE: dict[str, str] = {}
