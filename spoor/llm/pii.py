"""Problem 4: personal information inside free text.

Method: regular expressions propose spans with a base score; checksum
validators (Luhn for payment cards, mod-97 for bank accounts, mod 11,10 for
tax numbers) and words beside a span raise or lower it; spans below
``THRESHOLD`` fall, and of overlapping ones the better stays. Names of people
are proposed where a family name meets a given name, an initial or a title;
both kinds are known from the list of names or alike to it by their endings,
and a name that is also a common word counts only beside another.

One narrow pass in Arrow batches: no shuffle but that which takes each unit
once. The name list is sent to all tasks; one of more than ``MAX_NAMES`` names is an error
(the table is fixed and far smaller).

Defined results
* null and blank texts hold nothing; redaction leaves them as they are;
* positions count code points from 0; a span leaves out labels, titles,
  enclosing brackets and schemes;
* spans do not overlap; a name inside another item is none of its own;
* equal items of a text are rows of their own; rows with the same id are one
  unit; an empty name list leaves names with titles or family endings none;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.runtime import load

MAX_NAMES = 200_000
THRESHOLD = 0.5
#: Characters before a span in which words change its score.
NEARBY = 28
PLACEHOLDER = {
    "email": "[EMAIL]",
    "phone": "[PHONE]",
    "id_number": "[ID_NUMBER]",
    "street_address": "[ADDRESS]",
    "person_name": "[NAME]",
    "payment": "[PAYMENT]",
}

# --- validators ------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def mod11_10(digits: str) -> bool:
    product = 10
    for c in digits[:-1]:
        total = (int(c) + product) % 10 or 10
        product = total * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


# --- words beside a span ------------------------------------------------------

_NOT_PERSONAL = re.compile(
    r"(?i)\b(?:job|ticket|build|batch|hash|commit|row|line|port|step|version|v|error|code|order|rev|sha|pid|lot|took|since|at)(?: id| no\.?| nr\.?| #| number)?[:= #]*$"
)
_TAX = re.compile(r"(?i)(?:\btax(?:payer)?\b|\btin\b|steuer|\bfiscal|\bnif\b|\bsocial|insurance|versicherung|\bssn\b|\bitin\b|sécu|\bid[- ]?(?:no|nr|number)\b)[^\n]{0,14}$")
_DOCUMENT = re.compile(r"(?i)(?:passport|reisepass|passeport|pasaporte|id[- ]?card|ausweis|carte d'identité|identity card|driving licen[cs]e|führerschein|permis)[^\n]{0,10}$")
_CALL = re.compile(r"(?i)(?:\btel|phone|\bcall|\bfax|mobile|\bring\b|handy|texted|erreichbar|on-call|numéro|whatsapp|\bsms\b)[^\n]{0,14}$")

# --- patterns: (kind, trigger, pattern, base score) ------------------------------

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r" ?(?:\[ ?at ?\]|\( ?at ?\)|\{ ?at ?\}) ?"
_DOT = r"(?: ?(?:\[ ?dot ?\]|\( ?dot ?\)|\{ ?dot ?\}) ?|\.)"
EMAIL = re.compile(rf"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@(?:{_LABEL}\.)+[A-Za-z]{{2,24}}(?![\w@])")
EMAIL_BRACKETS = re.compile(rf"(?i)(?<![\w.+%-])[\w+%-]+(?:{_DOT}[\w+%-]+)*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[a-z]{{2,24}}(?!\w)")
EMAIL_WORDS = re.compile(r"(?i)(?<![\w.-])[\w+-]+(?: dot [\w+-]+)* at [a-z0-9-]+(?: dot [a-z0-9-]+)* dot [a-z]{2,24}(?!\w)")

_EDGE = r"(?<![\w+.\-/])"
_BEFORE = r"(?<![\w+.\-/])"
PHONES = [
    (re.compile(rf"{_BEFORE}\+\d{{1,3}}(?:[ .\-/]?\(\d{{1,4}}\))?(?:[ .\-/]?\d{{1,5}}){{2,6}}(?: ?(?:ext\.?|x) ?\d{{1,5}})?(?!\w)"), 0.9),
    (re.compile(rf"{_BEFORE}\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}(?: ?(?:ext\.?|x) ?\d{{1,5}})?(?![\w-])"), 0.8),
    (re.compile(rf"{_EDGE}(?:1[ .-])?\d{{3}}([.-])\d{{3}}\1\d{{4}}(?: ?(?:ext\.?|x) ?\d{{1,5}})?(?![\w-]|\.\d)"), 0.7),
    (re.compile(rf"{_EDGE}0\d(?:([ .-])\d\d)(?:\1\d\d){{3}}(?![\w-]|\.\d)"), 0.7),
    (re.compile(rf"{_EDGE}0\d{{3,4}}[ /-]\d{{3}} ?\d{{3}}(?![\w-]|\.\d)"), 0.7),
    (re.compile(rf"{_EDGE}0\d{{2,4}}[ /-]\d{{4,8}}(?:-\d{{1,4}})?(?![\w-]|\.\d)"), 0.4),
    (re.compile(rf"{_EDGE}00[1-9]\d{{8,12}}(?![\w-]|\.\d)"), 0.6),
]
IDS = [
    (re.compile(r"(?<![\w.\-/])(?!000|666)\d{3}([- ])\d\d\1\d{4}(?![\w-]|\.\d)"), 0.7, None),
    (re.compile(r"(?i)(?<![\w.\-/])[A-CEGHJ-PQR-TW-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?![\w-])"), 0.7, None),
    (re.compile(r"(?<![\w.\-/])\d{2} ?\d{3} ?\d{3} ?\d{3}(?![\w-]|\.\d)"), 0.0, "tax"),
    (re.compile(r"(?i)(?<![\w.\-/])[A-Z]{1,2} ?\d{6,8}(?![\w-])"), 0.0, "document"),
    (re.compile(r"(?<![\w.\-/])(?:\d{9}|\d{3} \d{3} \d{3}|\d{8}[A-Z]|[XYZ]\d{7}[A-Z])(?![\w-])"), -0.1, "tax"),
]
PAYMENTS = [
    (re.compile(r"(?<![\w.-])(?:\d[ -]?){12,18}\d(?![\w-])"), luhn, 13, 19),
    (re.compile(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"), mod97, 15, 34),
]
_CITY = r"[^\W\d_][^\W\d_'-]+(?:[ -](?-i:[A-ZÀ-Þ])[^\W\d_'-]+)?"
ADDRESSES = [
    # 12 Name Street, Apt 3A, City, ZZ 01234; 12 name st in city
    re.compile(
        rf"(?i)(?<![\w.\-/])\d{{1,5}}[a-z]? [^\W\d_][^\W\d_'-]+(?: [^\W\d_][^\W\d_'-]+)? (?:street|st|road|rd|lane|ln|close|avenue|ave|drive|dr|boulevard|blvd|court|ct|way|place|pl|terrace)\b\.?"
        rf"(?:(?:, (?:apt|unit|suite|flat|no)\.? ?\w{{1,5}})(?:,? {_CITY})?|, {_CITY}| in {_CITY})(?:,? [A-Z]{{2}} \d{{4,5}})?"
    ),
    re.compile(rf"(?i)(?<![\w.\-/])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|av\.|chemin|boulevard|bd|place|allée|impasse|quai|route|cours)(?: (?:de la|de l'|du|des|de|d'))? ?[^\W\d_][^\W\d_'-]+(?: [^\W\d_][^\W\d_'-]+)?,? \d{{5}} {_CITY}"),
    re.compile(rf"(?i)(?<![\w.\-/])[^\W\d_][^\W\d_-]*(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer) \d{{1,4}}[a-z]?(?:, \d{{5}} {_CITY}|, {_CITY})?"),
    re.compile(rf"(?i)(?<![\w.\-/])(?:calle|avenida|avda\.|plaza|paseo|camino|carrer)(?: (?:de la|de los|del|de))? [^\W\d_][^\W\d_'-]+(?: [^\W\d_][^\W\d_'-]+)? \d{{1,4}}(?:, \d{{1,2}}\.?º ?\w?)?(?:, (?:\d{{5}} )?{_CITY})?"),
]
#: Words and endings that name a kind of street in the patterns above (fixed values).
_STREET_WORDS = frozenset(
    "street st road rd lane ln close avenue ave drive dr boulevard blvd court ct way place pl terrace "
    "rue av chemin bd allée impasse quai route cours calle avenida avda plaza paseo camino carrer".split()
)
_STREET_ENDS = ("straße", "strasse", "str", "weg", "allee", "platz", "gasse", "ring", "damm", "ufer")
#: Words that stand between a number and a street type without naming a street (fixed values).
_NO_STREET = frozenset("and or to the of a an in at by for with from then und et y ou we they it".split())

#: Where a number worth a closer look begins; dates are none.
_NUMBER = re.compile(r"(?<![\w.\-/+])(?!\d{4}-\d\d-\d\d)(?:[A-Za-z]{1,2} ?)?[+(]?\d[\d()./ -]{5,}")
_WORD = re.compile(r"[^\W\d_]+")


def _number_spans(text: str, at: int, end: int):
    """Proposals that begin between ``at`` and ``end``: at its first sign, and after each blank or bracket in it."""
    starts = [i for i in range(at, end) if i == at or text[i - 1] in " (" or not text[i - 1].isalnum() and text[i] == "+"]
    for i in starts:
        if text[i] in " ./-)":
            continue
        before = text[max(0, i - NEARBY) : i]
        other = 0.6 if _NOT_PERSONAL.search(before) else 0.0
        tax = bool(_TAX.search(before))
        for pattern, base in PHONES:
            m = pattern.match(text, i)
            if m and 8 <= sum(c.isdigit() for c in m.group()) <= 20:
                yield i, m.end(), "phone", base + (0.2 if _CALL.search(before) else 0) - other - 0.4 * tax
        for pattern, base, label in IDS:
            m = pattern.match(text, i)
            if not m:
                continue
            score = base - other
            if label == "tax":
                digits = re.sub(r"\D", "", m.group())
                score += 0.8 * tax + (0.1 if len(digits) == 11 and mod11_10(digits) else 0)
            elif label == "document":
                score += 0.8 if _DOCUMENT.search(before) else 0
            else:
                score += 0.2 * tax
            yield i, m.end(), "id_number", score
        for pattern, valid, least, most in PAYMENTS:
            m = pattern.match(text, i)
            if m and not other:
                plain = re.sub(r"[ -]", "", m.group())
                if plain[0] != "0" and least <= len(plain) <= most and len(set(plain)) > 1:
                    yield i, m.end(), "payment", 0.3 + (0.4 if valid(plain) else -0.3)


def _other_spans(text: str, street: bool):
    """(start, end, kind, score) proposals of all kinds but names."""
    if "@" in text:
        for m in EMAIL.finditer(text):
            yield m.start(), m.end(), "email", 1.0
    lowered = text.lower()
    if "at]" in lowered or "at)" in lowered or "at }" in lowered or "at}" in lowered or "at ]" in lowered or "at )" in lowered:
        for m in EMAIL_BRACKETS.finditer(text):
            yield m.start(), m.end(), "email", 1.0
    if " at " in lowered and " dot " in lowered:
        for m in EMAIL_WORDS.finditer(text):
            yield m.start(), m.end(), "email", 0.9
    for found in _NUMBER.finditer(text):
        yield from _number_spans(text, found.start(), found.end())
    if street:
        for pattern in ADDRESSES:
            for m in pattern.finditer(text):
                words = m.group().split(" ", 2)
                if len(words) > 1 and words[1].lower() in _NO_STREET:
                    continue
                yield m.start(), m.end(), "street_address", 0.95


# --- names -----------------------------------------------------------------------

#: Titles before names and words that open a sentence rather than a name (fixed values).
TITLES = frozenset("mr mrs ms miss dr prof frau herr mme mlle monsieur madame sr sra señor señora".split())
_OPENERS = frozenset(
    "the a an and or but of to in on at by for with from as if is it we i you he she they ask cc tell call mail according after before since found please review lunch "
    "demande écris bitte von mit der die das ein le la les un une el los las una my name this that not no yes done thanks regards best".split()
)


class Names:
    """What the list of names says about a word: given or family, known or alike, common or not."""

    def __init__(self, rows: list[tuple[str, str]], commonness: dict[str, float] | None = None):
        self.given = {n.lower() for n, k in rows if k == "given"}
        self.family = {n.lower() for n, k in rows if k == "family"}
        self.ends = {}
        for kind, held in (("given", self.given), ("family", self.family)):
            for size in (2, 3, 4):
                self.ends[kind, size] = Counter(n[-size:] for n in held if len(n) > size + 1)
        self.cache: dict[str, tuple[int, int]] = {}
        self.flags: dict[str, int] = {}

    def _alike(self, word: str, kind: str) -> int:
        """2 if the ending of four is shared by names of this kind, 1 if only a shorter one."""
        if len(word) < 5:
            return 0
        if self.ends[kind, 4][word[-4:]] >= 3:
            return 2
        total = max(1, len(self.given if kind == "given" else self.family))
        if self.ends[kind, 3][word[-3:]] >= 3 or self.ends[kind, 2][word[-2:]] >= max(5, total // 16):
            return 1
        return 0

    def rate(self, word: str) -> tuple[int, int]:
        """(given, family): 3 known, 2 or 1 alike, 0 neither."""
        w = word.lower()
        found = self.cache.get(w)
        if found is None:
            given = 3 if w in self.given else self._alike(w, "given")
            family = 3 if w in self.family else self._alike(w, "family")
            if len(self.cache) > 1_000_000:
                self.cache.clear()
            found = self.cache[w] = (given, family)
        return found


    def flag(self, word: str) -> int:
        """Bits of a word as written: 1 makes a name likely, 2 and 4 together do, 8 names a kind of street."""
        given, family = self.rate(word)
        case = _case(word)
        w = word.lower()
        bits = (family >= 2 or (family == 1 and case in "CU")) * 1 | (given == 3) * 2 | (family == 1) * 4
        bits |= (w in _STREET_WORDS or w.endswith(_STREET_ENDS)) * 8
        if len(self.flags) > 1_000_000:
            self.flags.clear()
        self.flags[word] = bits
        return bits


def _case(word: str) -> str:
    if word[0].isupper() and word[1:].islower():
        return "C"
    if word.isupper() and len(word) > 1:
        return "U"
    return "l" if word.islower() else "x"


def _name_spans(text: str, names: Names):
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    n = len(words)
    for i, (s, e, w) in enumerate(words):
        family = names.rate(w)[1]
        if not family:
            continue
        case = _case(w)
        if case == "x" or (s and (text[s - 1] in "_@/\\." or text[s - 1].isdigit())) or (e < len(text) and (text[e] in "_@/\\(" or text[e].isdigit())):
            continue
        if e + 1 < len(text) and text[e] == "." and text[e + 1].isalnum():
            continue
        end = e
        if e < len(text) - 1 and text[e] == "-" and i + 1 < n and words[i + 1][0] == e + 1 and _case(words[i + 1][2]) == case:
            end = words[i + 1][1]  # a double family name; its second half is met again below
        if s and text[s - 1] == "-":
            continue
        # given name, perhaps an initial, family name
        j = i - 1
        if j >= 0:
            ps, pe, p = words[j]
            gap = text[pe:s]
            if len(p) == 1 and p.isupper() and gap == ". " and case in "CU":
                k = j - 1
                if k >= 0 and text[words[k][1] : ps] == " ":
                    gs, _, g = words[k]
                    score = _pair(names, g, family, case, _title(text, words, k))
                    if score:
                        yield gs, end, "person_name", score
                        continue
                if (not ps or not text[ps - 1].isalnum()) and (family == 3 or family == 2 or (family == 1 and case == "C")):
                    yield ps, end, "person_name", 0.7
                    continue
            elif gap == " " and len(p) > 1 and not (ps and (text[ps - 1] in "_@/\\.-`" or text[ps - 1].isdigit())):
                score = _pair(names, p, family, case, _title(text, words, j))
                if score:
                    yield ps, end, "person_name", score
                    continue
        # family name, given name
        if i + 1 < n:
            after = i + 1 + (end != e)
            if after < n and text[end : words[after][0]] == ", ":
                g = words[after][2]
                given = names.rate(g)[0]
                if len(g) > 2 and _case(g) == case and case in "CU" and g.lower() not in _OPENERS and (given or family == 3):
                    yield s, words[after][1], "person_name", 0.65


def _title(text: str, words, i: int) -> bool:
    return i > 0 and words[i - 1][2].lower() in TITLES and text[words[i - 1][1] : words[i][0]] in (" ", ". ")


def _pair(names: Names, given: str, family: int, case: str, titled: bool) -> float:
    """Score of a given name before a family name of this rating and case; 0 if they are no name."""
    g = given.lower()
    if g in _OPENERS or g in TITLES or _case(given) != case:
        return 0.0
    rating = names.rate(given)[0]
    if case == "C":
        if family >= 2:
            return 0.8
        return 0.7 if titled or rating else 0.0
    if rating == 3 or family == 3:
        return 0.75
    return 0.6 if family == 2 and rating else 0.0


def find(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal items of a text, in order, not overlapping."""
    if not text or not text.strip():
        return []
    bits, known = 0, names.flags.get
    for w in set(_WORD.findall(text)):
        b = known(w)
        bits |= names.flag(w) if b is None else b
    found = [p for p in _other_spans(text, bits & 8 > 0) if p[3] >= THRESHOLD]
    if bits & 1 or bits & 6 == 6:
        found += [p for p in _name_spans(text, names) if p[3] >= THRESHOLD]
    if not found:
        return []
    # other kinds before names, then better, longer, earlier ones
    found.sort(key=lambda p: (p[2] == "person_name", -round(p[3], 3), p[0] - p[1], p[0]))
    kept: list[tuple[int, int, str]] = []
    for s, e, kind, _ in found:
        if all(e <= a or s >= b for a, b, _ in kept):
            kept.append((s, e, kind))
    return sorted(kept)


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with a typed placeholder for each span."""
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], PLACEHOLDER[kind]]
        at = e
    return "".join([*out, text[at:]])


def _names(names: DataFrame) -> Names:
    rows = names.select(F.trim("name").alias("name"), F.lower(F.trim("kind")).alias("kind")).where("name <> ''").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"the list holds more than {MAX_NAMES} names; none is left out silently")
    return Names([(r["name"], r["kind"]) for r in rows])


def personal_items(df: DataFrame, names: DataFrame, id_col: str = "unit_id", text_col: str = "text") -> DataFrame:
    """(unit_id, kind, start_pos, end_pos, value) of each personal item."""
    held = df.sparkSession.sparkContext.broadcast(_names(names))

    def rows(batches):
        for batch in batches:
            ids, at, kinds, starts, ends, values = batch.column(0), [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for s, e, kind in find(text, held.value):
                    at.append(i), kinds.append(kind), starts.append(s), ends.append(e), values.append(text[s:e])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(values, pa.string())],
                names=["unit_id", "kind", "start_pos", "end_pos", "value"],
            )

    src = df.select(F.col(id_col).cast("string").alias("unit_id"), F.col(text_col).cast("string").alias("text")).where("unit_id IS NOT NULL AND text IS NOT NULL")
    return src.mapInArrow(rows, "unit_id string, kind string, start_pos long, end_pos long, value string").dropDuplicates(["unit_id", "start_pos"])


def redacted(df: DataFrame, names: DataFrame, id_col: str = "unit_id", text_col: str = "text") -> DataFrame:
    """(unit_id, items, text): each unit's text with placeholders, and how many there are."""
    held = df.sparkSession.sparkContext.broadcast(_names(names))

    def rows(batches):
        for batch in batches:
            counts, texts = [], []
            for text in batch.column(1).to_pylist():
                spans = find(text, held.value)
                counts.append(len(spans)), texts.append(redact(text, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(texts, pa.string())], names=["unit_id", "items", "text"])

    src = df.select(F.col(id_col).cast("string").alias("unit_id"), F.col(text_col).cast("string").alias("text")).where("unit_id IS NOT NULL")
    return src.mapInArrow(rows, "unit_id string, items int, text string").dropDuplicates(["unit_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per personal item in a unit's text."""
    items = personal_items(load(spark, sf_dir, "trace_units"), load(spark, sf_dir, "name_list"))
    return items.where("kind <> 'payment'").select("unit_id", "kind", "start_pos")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again with typed placeholders."""
    return redacted(load(spark, sf_dir, "trace_units"), load(spark, sf_dir, "name_list"))


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
ORACLE: dict[str, str] = {}
