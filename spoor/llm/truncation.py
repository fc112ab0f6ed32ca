"""Problem 5: text cut off by field limits or in transfer.

Method, in three steps over the distinct texts (equal texts are one, keyed by
a 64-bit hash):

1. Near-copies. Min-hash banding over shingles of five words groups all texts
   in buckets. A text is held against the longest text of its bucket and the two
   next longer ones; if none of these holds 0.8 of its shingles, against all
   longer ones. Verified pairs are aligned at the shorter text's last words: it is cut if
   the copy goes on there in the middle of a sentence, whatever its last mark.
2. Marks. Of the rest, a text that ends in a cut mark, an open record or an open block
   is cut; one that ends in a closing mark, a closed record or a closed block is
   complete. What remains, and what only seems closed, is undecided.
3. Closing words. The likelihood that an undecided text ends here by itself is
   held against that of a cut just here. By itself it ends as often as other
   texts end after the same masked opening of their last sentence, or as
   sentences and lines within texts do after that opening or the same closing words (1 to
   4). A cut is as likely here as the opening goes on within texts, or as what
   stands before the last word is followed by longer words that begin with it. A
   word never met inside a text is cut itself. The share of complete texts among
   undecided ones of the same role and kind is fitted by expectation
   maximisation; where many more undecided texts of a role have exactly this
   length than lengths nearby, a field limit lies there, and the share is
   as much smaller. A short text that many units have is a saying, and whole.

Counts are made by narrow passes; of the contexts, those that undecided texts
end in are shuffled, others only if they share a bit of a map of sixteen bits a key (at
most 2^28, beyond which more of the others pass; the result never differs).

Defined results
* null and blank texts are no cases; trailing white space is no word, but texts
  that end in a blank are a kind of their own, as a finished text rarely does;
* rows with the same id count once; a role is trimmed and lowered, null is '';
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.runtime import load, materialize

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 12, 4
#: A text of at most SHORT words that SAID units or more have is a saying.
SHORT, SAID = 6, 5
#: Tokens counted together.
BLOCK = 1 << 20
#: Bits of the map of wanted contexts for each of them, and at most.
BITS_A_KEY, MOST_BITS = 16, 1 << 28
#: Next longer texts of a bucket that a text is held against at once.
NEXT = 2
#: Lengths to each side that say how many texts to expect of a length.
NEARBY = 8
#: Share of cut texts among the places where a cut could lie, at most.
CUT_RATE = 0.01

_TOKEN = re.compile(r"\w+(?:[./:\\-]\w+)*|[^\w\s`]|\n+")
_HEX = re.compile(r"(?=.*\d)[0-9a-f]+$")
_STAMP = re.compile(r"[\d.:-]+$")
_LOG = re.compile(r"^(?:\[result\] )?\d{4}-\d\d-\d\d")
_CUT_MARK = re.compile(r"(?:�|…|\[\s*(?:cut|truncated|snip|\.\.\.|…)\s*\]|\((?:cut|truncated)\)|<truncated>)\s*$", re.I)
_LOW_NAME = re.compile(r"[a-z]+\d*\s*$")
_SIGN_OFF = re.compile(r"(?im)^(?:best|regards|kind regards|best regards|vg|mfg|lg|cheers|cordialement|saludos|gruß|grüße|--),?\s*$")
#: Words that shape a sentence; all others are masked in its opening (fixed values).
FRAME = frozenset(
    "the a an and or but so to in of on at by for with from is are was be it we i you they that this which who what when where why how while after before since "
    "if as than then until once next behind both per no not only had has have can could should would will may cannot set let me my our your there now twice again out up "
    "der die das und oder in zu mit von auf für ist sind nicht le la les des et ou de du en est sont pas los las el y o con por es son un una une".split()
)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Keys of the beginning of a text; what tells other keys apart.
_START, _END, _PREFIX = np.uint64(11), np.uint64(77), np.uint64(8)
#: Longest beginning of a word that is looked up.
_LONGEST = 40


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype("u8")
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _hash(strings: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(strings, object), categorize=False)


def shape(token: str) -> str:
    """A token with what varies freely masked: numbers, hashes, stamps and names of things."""
    first = token[0]
    if first == "\n":
        return "\n"
    if not (first.isalnum() or first == "_"):
        return token
    if token.isdigit():
        return "<n>" if len(token) < 5 else f"<n{len(token)}>"
    if first.isdigit() or _HEX.match(token):
        if _STAMP.match(token):
            return "".join(str(min(9, len(p))) if p.isdigit() else p for p in re.split(r"([.:-])", token))
        return f"<h{len(token)}>" if _HEX.match(token) else "<x>"
    if token.isalpha() and (token.islower() or token.istitle()):
        return token.lower()
    return "<id>"


def masked(form: str) -> str:
    return form if not form.isalpha() or form in FRAME else "*"


class Block:
    """Tokens of many texts in a row, with context keys at each."""

    ORDERS = 4

    def __init__(self, texts: list[str]):
        tokens = [_TOKEN.findall(t.rstrip()) for t in texts]
        self.sizes = np.array([len(t) for t in tokens], "i8")
        flat = [t for part in tokens for t in part]
        n = len(flat)
        self.ends = np.cumsum(self.sizes)
        code, unique = pd.factorize(np.array(flat, object)) if n else (np.empty(0, "i8"), np.empty(0, object))
        forms = [shape(t) for t in unique]
        raw, form, mask = _hash(list(unique)), _hash(forms), _hash([masked(f) for f in forms])
        breaks = np.array([f in ".!?" or f == "\n" for f in forms], bool)
        # hashes, numbers and stamps vary freely and marks are no words: only the others can be unknown
        wordy = np.array([f.isalpha() or f == "<id>" for f in forms], bool)
        self.wordy = wordy[code] if n else np.empty(0, bool)
        named = np.array([f == "<id>" for f in forms], bool)
        self.named = named[code] if n else np.empty(0, bool)
        lowered = _hash([t.lower() for t in unique])
        self.lowered = lowered[code] if n else np.empty(0, "u8")
        self.raw = raw[code] if n else np.empty(0, "u8")
        self.code, self.unique, self.is_word = code, unique, wordy
        self.breaks = breaks[code] if n else np.empty(0, bool)
        at = np.arange(n)
        text_start = np.repeat(self.ends - self.sizes, self.sizes)
        self.last = np.zeros(n, bool)
        self.last[self.ends[self.sizes > 0] - 1] = True
        w = form[code] if n else np.empty(0, "u8")
        follows = np.r_[self.breaks[1:], False]
        self.bounds = (follows & ~self.last) & ~self.breaks
        # keys of the closing words, of one to four
        self.keys = []
        with np.errstate(over="ignore"):
            key = np.zeros(n, "u8")
            for order in range(self.ORDERS):
                key = _mix(key * _GOLD + np.r_[np.zeros(min(order, n), "u8"), w[: max(0, n - order)]] + np.uint64(order + 1))
                inside = at - order >= text_start
                self.keys.append((np.where(inside, key, np.uint64(0)), inside))
            # key of the masked opening of the sentence up to here
            starts = np.r_[True, self.breaks[:-1]] | (at == text_start) if n else np.empty(0, bool)
            head = np.maximum.accumulate(np.where(starts, at, 0)) if n else at
            m = np.where(at == head, w, mask[code] if n else w)
            place = at - head
            weight = _mix((place.astype("u8") + np.uint64(7)) * _GOLD) | np.uint64(1)
            total = np.cumsum(m * weight, dtype="u8")
            before = np.where(head > 0, total[np.maximum(head - 1, 0)], np.uint64(0))
            self.opening = _mix(total - before + np.uint64(99))

        # the last word of each text that is no mark, -1 if it has none
        inner = np.where(self.breaks, -1, at)
        self.closing = np.full(len(self.sizes), -1)
        some = np.flatnonzero(self.sizes > 0)
        if n:
            low = np.maximum.reduceat(inner, (self.ends - self.sizes)[some])
            self.closing[some] = np.where(low >= (self.ends - self.sizes)[some], low, -1)
        self.text_start = text_start

    def contexts(self, i: int) -> list[int]:
        """Keys of the contexts that end at token i: one to four words (0 if it has fewer), the opening, the word
        as written and as a name in any case."""
        out = [int(k[i]) if ok[i] else 0 for k, ok in self.keys]
        return [*out, int(self.opening[i]), *((int(_mix(h[i : i + 1] + np.uint64(n))[0]) if self.wordy[i] else 0) for h, n in ((self.raw, 5), (self.lowered, 6)))]

    def around(self, i: int) -> list[int]:
        """Keys of what stands before token i, of texts ending in its opening, and of the word as the beginning of others."""
        if i == self.text_start[i]:
            before = _START
        elif self.breaks[i - 1]:
            before = self.keys[0][0][i - 1]
        else:
            before = self.opening[i - 1]
        end = _mix(self.opening[i : i + 1] + _END)[0]
        return [int(before), int(end), int(_mix(self.raw[i : i + 1] + _PREFIX)[0]) if self.wordy[i] else 0]


def open_block(text: str) -> bool:
    """Whether a fenced block is not closed."""
    return len(re.findall(r"(?m)^```", text)) % 2 == 1


def kind(text: str) -> str:
    if text[-1] in " \t":
        return "blank"
    if text.endswith("..."):
        return "dots"
    line = text.rstrip().rsplit("\n", 1)[-1]
    if _LOG.match(line):
        return "log"
    if re.match(r"\s*[-*•] ", line):
        return "list"
    return "prose"


def judge(text: str) -> str:
    """'cut', 'complete', 'open' (undecided) or 'seems' (closed by a full stop within a number or a name)."""
    end = text.rstrip()
    if not end:
        return "complete"
    if _CUT_MARK.search(end):
        return "cut"
    line = end.rsplit("\n", 1)[-1]
    if line.startswith("[tool:") or line.startswith('[result] {"') or line.startswith('{"'):
        return "complete" if line.endswith(("}", "]")) and line.count('"') % 2 == 0 else "cut"
    if open_block(end):
        return "cut"
    if line.strip() == "```":
        return "complete"
    if line.replace("```", "").count("`") % 2:
        return "cut"
    tail = end[-400:].rsplit("\n\n", 1)[-1] if len(end) > 400 else end
    if _SIGN_OFF.search("\n".join(end.split("\n")[-5:-1])) and tail:
        return "complete"
    if end.endswith("...") and len(end) > 3:
        return "open"
    last = end[-1]
    if last in "!?" or last in "\"'”’»" and end[-2:-1] in ".!?":
        return "complete"
    if last == ".":
        return "seems" if len(end) > 1 and end[-2].isdigit() or _LOG.match(line) else "complete"
    return "open"


# --- passes ------------------------------------------------------------------------


def _blocks(batches, columns: int):
    """Rows of the batches regrouped so that each block has about BLOCK / 4 words' worth of text."""
    held, size = [[] for _ in range(columns)], 0
    for batch in batches:
        lists = [batch.column(i).to_pylist() for i in range(columns)]
        for row in zip(*lists):
            for h, v in zip(held, row):
                h.append(v)
            size += len(row[1])
            if size >= 4 * BLOCK:
                yield held
                held, size = [[] for _ in range(columns)], 0
    if held[0]:
        yield held


_ENDS = "th long, role string, kind string, length int, verdict string, keys array<long>"
#: Slots of the keys of an undecided text (from 1): closing words, opening, word, name, what is around, the same as a name.
WORDS, OPENING, WORD, NAME, BEFORE, ENDS, LONGER, AS_NAME = 1, 5, 6, 7, 8, 9, 10, 11



def _ends(batches):
    """Undecided texts with the contexts they end in; decided ones with none."""
    for ths, texts, roles, units in _blocks(batches, 4):
        verdicts = [judge(t) for t in texts]
        # a short saying of many units is whole
        verdicts = ["complete" if v == "open" and n >= SAID and len(t.split()) <= SHORT else v for v, n, t in zip(verdicts, units, texts)]
        asked = [i for i, v in enumerate(verdicts) if v in ("open", "seems")]
        keys: list = [[] for _ in texts]
        if asked:
            # marks after the closing words are no words of their own
            block = Block([texts[i].rstrip().rstrip(".") if verdicts[i] == "seems" or texts[i].rstrip().endswith("...") else texts[i] for i in asked])
            # a text in lower case throughout may end in a name that is written otherwise elsewhere
            low = [j for j, i in enumerate(asked) if texts[i] == texts[i].lower() and _LOW_NAME.search(texts[i])]
            named = Block([_LOW_NAME.sub("x_x", texts[asked[j]]) for j in low])
            second = {j: named.contexts(int(named.ends[k]) - 1)[:5] for k, j in enumerate(low)}
            for j, i in enumerate(asked):
                if block.sizes[j]:
                    last = int(block.ends[j]) - 1
                    both = block.contexts(last) + block.around(last) + second.get(j, [])
                    keys[i] = np.array(both, "u8").view("i8").tolist()
                else:
                    verdicts[i] = "complete"
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ths, pa.int64()),
                pa.array(roles, pa.string()),
                pa.array([{"open": kind(t), "seems": "full stop"}.get(v, "") for t, v in zip(texts, verdicts)], pa.string()),
                pa.array([len(t) for t in texts], pa.int32()),
                pa.array(verdicts, pa.string()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["th", "role", "kind", "length", "verdict", "keys"],
        )


def _count(bitmap):
    """(key, c, b) partial counts of wanted contexts: how often met within texts, how often a boundary follows."""

    def rows(batches):
        wanted = bitmap.value
        for _, texts in _blocks(batches, 2):
            verdicts = np.array([judge(t) for t in texts])
            block = Block(texts)
            n = len(block.raw)
            at_all = np.arange(n)
            # what undecided and cut texts end in is no evidence of how sentences end within texts
            stop = np.where(verdicts == "complete", n + 1, block.closing)
            within = (at_all < np.repeat(stop, block.sizes)) & ~block.last
            inner = ~block.breaks & within
            keys, bounds, counts = [], [], []

            def add(key, bound, count=None):
                picked = wanted.has(key)
                keys.append(key[picked]), bounds.append(bound[picked])
                counts.append(np.ones(int(picked.sum()), "i8") if count is None else count[picked])

            for order, (key, ok) in enumerate(block.keys):
                # a mark alone counts too, as what stands before a sentence
                at = np.flatnonzero((within if order == 0 else inner) & ok)
                add(key[at], block.bounds[at])
            at = np.flatnonzero(inner)
            add(block.opening[at], block.bounds[at])
            none = np.zeros(n, bool)
            for word, where in ((_mix(block.raw + np.uint64(5)), inner), (_mix(block.lowered + np.uint64(6)), inner & block.named)):
                at = np.flatnonzero(where)
                add(word[at], none[at])
            add(np.full(int((block.sizes > 0).sum()), _START), np.zeros(int((block.sizes > 0).sum()), bool))
            ends = block.closing[(block.closing >= 0) & ((verdicts == "open") | (verdicts == "seems"))]
            add(_mix(block.opening[ends] + _END), none[ends])
            # words that begin with a wanted one
            often = np.bincount(block.code[inner], minlength=len(block.unique))
            longer = np.flatnonzero(block.is_word & (often > 0))
            begins = [u[:k] for u in block.unique[longer] for k in range(1, min(len(u), _LONGEST))]
            times = np.repeat(often[longer], [max(0, min(len(u), _LONGEST) - 1) for u in block.unique[longer]])
            if begins:
                add(_mix(_hash(begins) + _PREFIX), np.zeros(len(begins), bool), times.astype("i8"))
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(inverse, np.concatenate(counts), minlength=len(key)).astype("i8")
            b = np.bincount(inverse, np.concatenate(bounds), minlength=len(key)).astype("i8")
            # the rate at which boundaries follow words at all, under key 0
            key = np.r_[key, np.uint64(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view("i8")), pa.array(np.r_[c, int(inner.sum())]), pa.array(np.r_[b, int((block.bounds & inner).sum())])],
                names=["key", "c", "b"],
            )

    return rows


class Bits:
    """A map of keys to bits: wanted keys are always met, few others are."""

    def __init__(self, size: int, words: np.ndarray, bits: np.ndarray):
        self.size = size
        self.packed = np.zeros(size >> 6, "u8")
        self.packed[words] = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view("u8") % np.uint64(self.size)
        return (self.packed[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _bitmap(keys: DataFrame):
    """A broadcast map with the bits of the keys (a column ``key``) set, made in parts by the executors: at most MOST_BITS / 8 bytes."""
    n = keys.agg(F.approx_count_distinct("key")).first()[0]
    size = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_A_KEY * n - 1).bit_length()))
    # the key as an unsigned number modulo a power of two is its lowest bits
    at = F.col("key").bitwiseAND(F.lit(size - 1))
    words = keys.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    return keys.sparkSession.sparkContext.broadcast(Bits(size, found.column("word").to_numpy(), found.column("bits").to_numpy().view("u8")))


def _bands(batches):
    """(th, n, key) of the bands of texts of at least SHINGLE words."""
    for th, n, bands in _minhash(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(th, BANDS)), pa.array(np.repeat(n, BANDS)), pa.array(bands.ravel())], names=["th", "n", "key"])


def _minhash(batches):
    """(th, length, bands) of texts of at least SHINGLE words; band keys differ by band."""
    rng = np.random.default_rng(5)
    mult = rng.integers(1, 1 << 63, BANDS * ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)
    for ths, texts in _blocks(batches, 2):
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words])
        ok = np.flatnonzero(sizes >= SHINGLE)
        if not len(ok):
            continue
        flat = [w for i in ok for w in words[i]]
        code, unique = pd.factorize(np.array(flat, object))
        h = _hash(list(unique))[code]
        n = sizes[ok]
        ends = np.cumsum(n)
        with np.errstate(over="ignore"):
            s = np.zeros(len(h) - SHINGLE + 1, "u8")
            for j in range(SHINGLE):
                s = _mix(s * _GOLD + h[j : len(h) - SHINGLE + 1 + j])
            text_of = np.repeat(np.arange(len(ok)), n)[: len(s)]
            inside = np.arange(len(s)) + SHINGLE <= ends[text_of]
            s, starts = s[inside], np.r_[0, np.cumsum(n - SHINGLE + 1)[:-1]]
            bands = np.zeros((BANDS, len(ok)), "u8")
            for k in range(BANDS * ROWS):
                low = np.minimum.reduceat((s * mult[k]) >> np.uint64(16), starts)
                bands[k // ROWS] = _mix(bands[k // ROWS] * _GOLD + low + np.uint64(k))
            bands = _mix(bands + (np.arange(BANDS, dtype="u8") * _GOLD)[:, None])
        # signs, not words, tell a text cut within its last word from its copy
        yield np.array(ths, "i8")[ok], np.array([len(texts[i]) for i in ok], "i4"), np.ascontiguousarray(bands.T).view("i8")


def ends_early(short: str, long: str) -> str | None:
    """'cut' or 'complete' if ``short`` is a near-copy of ``long`` that stops before it, 'near' if it does not stop before; None if it is no copy."""
    a, b = short.split(), long.split()
    sa = {tuple(a[i : i + SHINGLE]) for i in range(len(a) - SHINGLE + 1)}
    sb = {tuple(b[i : i + SHINGLE]) for i in range(len(b) - SHINGLE + 1)}
    if not sa or len(sa & sb) < SIMILAR * len(sa):
        return None
    # align the last whole words of the shorter text, the very last perhaps cut itself
    tail = a[-SHINGLE:]
    for at in range(len(b) - SHINGLE, -1, -1):
        if b[at : at + SHINGLE - 1] == tail[:-1] and b[at + SHINGLE - 1].startswith(tail[-1]):
            rest = b[at + SHINGLE :]
            word = b[at + SHINGLE - 1]
            if word != tail[-1] and len(word) - len(tail[-1]) > 1:
                return "cut"
            return "near" if not rest else "complete" if tail[-1][-1] in ".!?" else "cut" if word[-1] not in ".!?" else "complete"
    return "near"


def _aligned(batches):
    """Rows (th, other, a, b) to (th, copy): 'cut', 'complete', 'near' (a near-copy that does not go on) or null."""
    for batch in batches:
        a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ends_early(x, y) for x, y in zip(a, b)], pa.string())], names=["th", "copy"])


def _shares(table: pa.Table) -> pa.Table:
    """The share of complete texts of one role and kind, by expectation maximisation over (bin of odds, count)."""
    odds = np.exp(np.clip(table.column("bin").to_numpy(), -400, 400) / 4.0)
    n = table.column("n").to_numpy().astype("f8")
    share = 0.5
    for _ in range(60):
        post = share * odds / (share * odds + 1 - share)
        share = float(np.clip((n * post).sum() / n.sum(), 0.02, 0.98))
    return pa.table({"role": [table.column("role")[0].as_py()], "kind": [table.column("kind")[0].as_py()], "share": [share]})


def near_copies(texts: DataFrame) -> DataFrame:
    """(th, whole): for texts (th, text) that are near-copies of one as long or longer: 0 if that goes on in mid-sentence, else 1."""
    bands = texts.select("th", "text").mapInArrow(_bands, "th long, n int, key long").distinct()
    order = Window.partitionBy("key").orderBy(F.desc("n"), "th")
    place = F.row_number().over(order)
    met = bands.select("th", "n", "key", place.alias("place"), F.first("th").over(order).alias("p0"), *(F.lag("th", k).over(order).alias(f"p{k}") for k in range(1, NEXT + 1)))
    met = materialize(met.where("place > 1").select("th", "n", "key", "place", *(f"p{k}" for k in range(NEXT + 1))), "p5-met")

    def aligned(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(texts.select("th", F.col("text").alias("a")), "th")
            .join(texts.select(F.col("th").alias("other"), F.col("text").alias("b")), "other")
            .select("th", "a", "b")
            .mapInArrow(_aligned, "th long, copy string")
            .where("copy IS NOT NULL")
        )

    first = met.select("th", F.explode(F.array(*(f"p{k}" for k in range(NEXT + 1)))).alias("other")).where("other IS NOT NULL").distinct()
    found = materialize(aligned(first), "p5-first")
    # one cut by a copy is settled; whoever is not meets all longer texts of its buckets
    rest = met.where(F.col("place") > NEXT + 2).join(found.where("copy = 'cut'").select("th").distinct(), "th", "left_anti")
    longer = met.select("key", F.col("th").alias("other"), F.col("place").alias("at"))
    others = rest.select("th", "key", "place").join(longer, "key").where("at < place").select("th", "other").distinct().join(first, ["th", "other"], "left_anti")
    every = found.unionByName(aligned(others)).where("copy <> 'near'")
    return every.groupBy("th").agg(F.min(F.when(F.col("copy") == "cut", 0).otherwise(1)).alias("whole"))


def truncation(df: DataFrame, id_col: str = "unit_id", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """(unit_id, verdict, cut): how each non-blank text ends and whether it was cut."""
    spark = df.sparkSession
    role = F.coalesce(F.lower(F.trim(F.col(role_col))), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("string").alias("unit_id"),
        F.xxhash64(text_col).alias("th"),
        F.col(text_col).cast("string").alias("text"),
        F.when(role == "toolresult", "tool").otherwise(role).alias("role"),
    ).where(F.col("unit_id").isNotNull() & F.col("text").rlike(r"\S"))
    texts = materialize(rows.groupBy("th").agg(
        F.first("text").alias("text"), F.min("role").alias("role"), F.approx_count_distinct("unit_id").alias("units")
    ), "p5-texts")
    ends = materialize(texts.select("th", "text", "role", "units").mapInArrow(_ends, _ENDS), "p5-ends")
    asked = ends.where(F.size("keys") > 0)
    copies = near_copies(texts)

    # closing words
    slots = asked.select("th", F.posexplode("keys").alias("slot", "key")).where("key <> 0")
    counts = texts.select("th", "text").mapInArrow(_count(_bitmap(slots.select("key"))), "key long, c long, b long").groupBy("key").agg(F.sum("c").alias("c"), F.sum("b").alias("b"))
    counts = materialize(counts, "p5-counts")
    words, bounds = counts.where("key = 0").select(F.sum("c"), F.sum("b")).first()
    words, bounds = words or 1, bounds or 1
    rate = min(0.5, max(1e-3, bounds / words))
    met = slots.join(counts, "key").groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("c", "b")))).alias("m"))
    undecided = max(1, asked.count())
    c = lambda i: F.coalesce(F.try_element_at("m", F.lit(i - 1))["c"], F.lit(0)).cast("double")
    b = lambda i: F.coalesce(F.try_element_at("m", F.lit(i - 1))["b"], F.lit(0)).cast("double")
    asks = lambda i: F.coalesce(F.try_element_at("keys", F.lit(i)), F.lit(0)) != 0

    def odds(first: int, opening: int, part):
        """How likely a text ends here by itself, over a cut just here."""
        p = (b(first) + 3 * rate) / (c(first) + 3)
        p = F.when((c(first + 1) == 0) & asks(first + 1), p * 0.15).otherwise((b(first + 1) + 3 * p) / (c(first + 1) + 3))
        for i in (first + 2, first + 3):
            p = (b(i) + 3 * p) / (c(i) + 3)
        p = F.least(F.lit(0.999), F.greatest(F.lit(1e-4), p))
        cuts = c(opening) - b(opening) + 3 * (1 - p) + part * c(BEFORE)
        own = F.lit(1.0)
        ends = F.greatest((b(opening) + 3 * p) * undecided / bounds, (c(ENDS) - own if opening == OPENING else F.lit(0.0)) - CUT_RATE * cuts)
        return F.log(ends / cuts * words / undecided)

    # of words, how many of those that begin like this one are longer; a number or hash always may be longer
    part = F.when(asks(WORD), c(LONGER) / (c(LONGER) + c(WORD) + 1)).otherwise(F.lit(1.0))
    as_name = asks(AS_NAME) & (c(NAME) > c(WORD))
    fit = odds(WORDS, OPENING, part)
    fit = F.when(as_name, F.greatest(fit, odds(AS_NAME, AS_NAME + 4, F.lit(0.0)))).otherwise(fit)
    known = ~asks(WORD) | (c(WORD) > 0) | as_name
    rated = asked.join(met, "th", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,struct<c:bigint,b:bigint>>")))
    rated = materialize(rated.select("th", "role", "kind", "length", "verdict", known.alias("known"), fit.alias("odds")), "p5-rated")
    hist = rated.where("known OR verdict = 'seems'").groupBy("role", "kind", F.round(F.col("odds") * 4).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    shares = hist.groupBy("role", "kind").applyInArrow(_shares, "role string, kind string, share double")
    # field limits: lengths that far more undecided texts of a role have than those nearby
    sizes = rated.groupBy("role", "length").agg(F.count("*").alias("n"))
    spread = sizes.select("role", "n", F.explode(F.sequence(F.col("length") - NEARBY, F.col("length") + NEARBY)).alias("length"), F.col("length").alias("of"))
    usual = spread.where("length <> of").groupBy("role", "length").agg((F.sum("n") / (2 * NEARBY)).alias("usual"))
    limits = sizes.join(usual, ["role", "length"], "left").na.fill(0.0, ["usual"]).where(F.col("n") > 3 * F.col("usual") + 10).select("role", "length", (F.col("usual") / F.col("n")).alias("expected"))
    scored = rated.join(shares, ["role", "kind"], "left").join(limits, ["role", "length"], "left")
    # a full stop is seldom what a limit leaves, and numbers before it are often new
    stopped = F.col("verdict") == "seems"
    share = F.greatest(F.lit(0.002), F.coalesce("share", F.lit(0.5)) * F.when(stopped, 1.0).otherwise(F.coalesce("expected", F.lit(1.0))))
    scored = scored.select("th", ((stopped | F.col("known")) & (F.log(share / (1 - share)) + F.col("odds") >= 0)).alias("complete"))
    verdict = (
        F.when(F.col("whole") == 0, "cut by its copy")
        .when(F.col("verdict").isin("cut", "complete"), F.col("verdict"))
        .when(F.col("whole") == 1, "complete by its copy")
        .when(F.coalesce("complete", F.lit(False)), "ends well")
        .otherwise("ends badly")
    )
    final = (
        ends.select("th", "verdict")
        .join(copies, "th", "left")
        .join(scored, "th", "left")
        .select("th", verdict.alias("verdict"))
        .withColumn("cut", F.col("verdict").isin("cut", "cut by its copy", "ends badly"))
    )
    units = rows.select("unit_id", "th").dropDuplicates(["unit_id"])
    return units.join(final, "th").select("unit_id", "verdict", "cut")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose text was cut before its end."""
    return truncation(load(spark, sf_dir, "trace_units")).where("cut").select("unit_id")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut texts of each cwd and role."""
    units = load(spark, sf_dir, "trace_units")
    role = F.coalesce(F.lower(F.trim("role")), F.lit(""))
    known = units.select("unit_id", "cwd", F.when(role == "toolresult", "tool").otherwise(role).alias("role")).dropDuplicates(["unit_id"])
    cut = truncation(units)
    return known.join(cut, "unit_id").groupBy("cwd", "role").agg(
        F.count("*").alias("units"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("int")), 6).alias("share")
    )


QUERIES = {"p5_found": p5_found, "p5_shares": p5_shares}
ORACLE: dict[str, str] = {}
