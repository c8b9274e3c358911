"""Sentence boundaries across languages and scripts.

Candidates are the ends of runs of terminal marks with the quotes and brackets that close after them. Each is
judged by a maximum-entropy model (logistic, over binary features and pairs of them) of its surroundings: the
mark, what closes, the gap, the token before (abbreviation, initial, acronym, number, length), the token
after (case, digits, script, opening mark, function word) and the token before that. The model is fitted
on reliable boundaries (``labelled_sentences``). Line breaks always end a unit; in Thai, white space does.

A candidate's features come from small closed sets, so the judgement of each combination is computed once per
worker and looked up afterwards. One Arrow pass, no shuffle. Defined results: null, empty and blank texts have
no units; repeated rows have theirs each; units have no white space at either end and cover all else.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarrafa.llm.labelled_sentences import TEXTS

# Abbreviations that lead to what follows (titles, streets, references), by language.
LEADING = set(
    "dr dra drs sr sra srs sras srta prof profa profs eng arq av r pça pca pc trav rod est al dep sen gov min cel cap ten maj gen sgt brig d dom da fr pe exmo exma sto sta cia art arts inc nº n nr no núm num fl fls p pg pág págs pag pp cf vol ed séc sec tel obs v vs fig tab aprox máx mín km "
    "str nr hr fr hrn frl bzw zb vgl abs kap mme mlle "
    "mr mrs ms messrs st mt ft rev hon capt col lt gov pres supt approx ca "
    "ud uds vda lic ing dpto avda c pza "
    "ул пр пл пер наб им стр см рис проф акад доц тов гр ст т тт напр ср гл кн обл р-н д г "
    "डॉ श्री श्रीमती प्रो कु د أ م ص".split()
)
# Abbreviations that may end a sentence as well.
ENDING = set("etc jr ltd ltda inc co corp s.a s/a a.m p.m u.s u.k e.u.a uu ee.uu seg segs ex al cit руб млн млрд тыс др пр кг км мин сек т.д т.п e.g i.e".split())
# What companies' names end in; a mark before it belongs to the name.
SUFFIXES = set("inc ltd ltda corp co llc plc gmbh ag sa cia".split())
# Words that open a sentence rather than go on with a name.
OPENERS = set(
    "o a os as ele ela eles elas um uma isso isto este esta esse essa aquele em no na nos nas segundo para por com quando se mas e já não ninguém quem como agora depois hoje ontem foi era há "
    "the he she it they we i you this that these those a an in on at no but and when who what there if as for "
    "el la los las él ella ellos un una en según para por con cuando si pero y ya no nadie su sus "
    "он она они это в на и но по не никто мэр".split()
)
_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
_CLOSE = "\"'”’»›」』）)\\]】〉》"
#: Marks with their closers; an ASCII full stop inside a number, an address or before a small letter is none.
_CANDIDATE = re.compile(rf"(?:[!?…‼⁇⁈⁉]|\.(?![a-zß-ÿа-яα-ώა-ჿ0-9_@/])|[。！？｡।॥؟۔።။។៕։།༎\u037e]|(?<=[\u0370-\u03ff\u1f00-\u1fff]);)[.!?…。！？｡؟]*[{_CLOSE}]*")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+|\s+(?=[฀-๿])")
_SPACE = re.compile(r"\s+")
_EDGES = "\"'“”‘’«»()[]¿¡—–-,;:"
#: Longer than any abbreviation, initial or item number: beyond it a token is told by its parts alone.
_LISTED = 40
_NEXT = re.compile(r"\w+(?:[-'’]\w+)*\.?")
_QUOTATIVE = ("と", "って", "という", "との", "など", "を", "に", "は", "が", "の", "も", "で")
_SAYING = ("说", "问", "道", "喊", "表示", "他说", "她说", "他问", "她问", "的")


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x600 <= o < 0x780:
        return "arabic"
    if 0x900 <= o < 0xE00:
        return "indic"
    if 0xE00 <= o < 0xE80:
        return "thai"
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00:
        return "cjk"
    return "other"


def _before(token: str, at_start: bool) -> str:
    """The class of the token in front of the mark."""
    bare = token.strip(_EDGES)
    if not bare:
        return "none"
    if not bare.isascii():
        bare = unicodedata.normalize("NFC", bare)
    low = bare.lower()
    if bare.isdigit():
        return "item" if at_start and len(bare) <= 3 else "number"
    if low in ENDING:
        return "ending"
    if len(bare) == 1 and bare.isalpha():
        return "initial" if bare.isupper() else "leading" if low in LEADING else "letter"
    if low in LEADING:
        return "leading"
    if "." in bare and all(len(x) <= 2 and x.isalpha() for x in bare.split(".")):
        return "acronym" if bare[0].isupper() else "dotted"
    if len(bare) == 2 and bare.isupper() and bare.isalpha():
        return "capitals"
    if any(c.isdigit() for c in bare):
        return "digits"
    return "word"


class _Line:
    """The tokens in front of a line's candidates, in order; each character is looked at once, however long a token is."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start = text, start
        self.gaps = _SPACE.finditer(text, start, end)
        self.gap = next(self.gaps, None)
        self.cased = not text[start:end].islower()
        self.first = self.gap.end() if self.gap and self.gap.start() == start else start
        self._open(start)

    def _open(self, at: int) -> None:
        self.at = self.upto = at
        self.short_parts, self.any_digit, self.all_digits, self.upper, self.parts = True, False, True, False, 0

    def before(self, mark: int) -> tuple[str, str]:
        """(class of the token that ends at a mark, what the one before it ends with: n for a digit, a for a stop)."""
        while self.gap and self.gap.end() <= mark:
            self._open(self.gap.end())
            self.gap = next(self.gaps, None)
        if mark - self.at <= _LISTED:
            kind = _before(self.text[self.at : mark], self.at <= self.first)
        else:
            kind = self._of_parts(mark)
        if kind not in ("leading", "ending", "letter", "initial"):
            return kind, ""
        j = self.at
        while j > self.start and self.text[j - 1].isspace():
            j -= 1
        last = self.text[j - 1] if j > self.start else ""
        return kind, "n" if last.isdigit() else "a" if last == "." else ""

    def _of_parts(self, mark: int) -> str:
        piece = self.text[self.upto : mark]
        if not self.parts:
            piece = piece.lstrip(_EDGES)
            self.upper = piece[:1].isupper()
        body = piece.rstrip(_EDGES)
        for part in body.split("."):
            if part:
                self.parts += 1
                self.short_parts &= len(part) <= 2 and part.isalpha()
                self.any_digit |= any(map(str.isdigit, part))
                self.all_digits &= part.isdigit()
        self.upto = mark
        if self.parts == 1 and self.all_digits:
            return "number"
        if self.parts > 1 and self.short_parts:
            return "acronym" if self.upper else "dotted"
        return "digits" if self.any_digit else "word"


def _after(text: str, i: int, end: int) -> tuple[str, str, str, str]:
    """(gap, opening mark, class of the next token, script) of what follows position i."""
    j = i
    while j < end and text[j].isspace():
        j += 1
    if j >= end:
        return "end", "", "end", "none"
    gap, opening = ("space" if j > i else "none"), ""
    while j < end and text[j] in "\"'“‘«‹「『（([¿¡—–-•":
        opening = "open" if text[j] not in "—–-•" else "dash"
        j += 1
        while opening == "dash" and j < end and text[j].isspace():
            j += 1
    if j >= end:
        return gap, opening, "end", "none"
    c = text[j]
    script = _script(c)
    if c.isdigit():
        return gap, opening, "digit", "latin"
    if not c.isalpha():
        return gap, opening, "comma" if c in ",;:，、；：،؛" else "other", "none"
    if script == "cjk":
        rest = text[j : j + 2]
        return gap, opening, "quotative" if rest.startswith(_QUOTATIVE) or rest in _SAYING or rest[:1] in _SAYING else "plain", script
    if script in ("arabic", "indic", "thai"):
        return gap, opening, "plain", script
    m = _NEXT.match(text, j, end)
    word = m.group() if m else c
    if word.rstrip(".").lower() in SUFFIXES and c.isupper():
        return gap, opening, "suffix", script
    if c.islower():
        return gap, opening, "camel" if len(word) > 1 and word[1].isupper() else "lower", script
    if word.endswith(".") and len(word) <= 3 and word[:-1].isupper():
        return gap, opening, "initials", script
    return gap, opening, "opener" if word.rstrip(".").lower() in OPENERS else "upper", script


def _kind(mark: str) -> str:
    c = mark[0]
    if mark.startswith("..") or c == "…":
        return "dots"
    return "stop" if c == "." else "ask" if c in "!?؟;\u037e‼⁇⁈⁉" else "full"


def features(key: tuple) -> list[str]:
    kind, closed, gap, opening, after, script, before, number_before, cased = key
    f = ["bias", f"k:{kind}", f"a:{after}", f"g:{gap}", f"s:{script}", f"ka:{kind}|{after}", f"kga:{kind}|{gap}|{after}", f"ca:{closed}|{after}", f"kca:{kind}|{closed}|{after}", f"o:{opening}", f"oa:{opening}|{after}", f"sa:{script}|{after}", f"kcs:{kind}|{closed}|{script}|{after}"]
    if not cased:
        f += [f"l:{kind}|{after}", f"lb:{kind}|{before}", f"lg:{kind}|{gap}", f"lba:{before}|{after}"]
    if kind == "stop":
        f += [f"b:{before}", f"ba:{before}|{after}", f"bo:{before}|{opening}", f"bn:{before}|{number_before}", f"bna:{before}|{number_before}|{after}", f"bg:{before}|{gap}"]
    return f


def candidates(text: str, start: int, end: int) -> Iterator[tuple[int, tuple]]:
    """(position after the marks and closers, key of the surroundings) of each candidate in a line."""
    line = None
    for m in _CANDIDATE.finditer(text, start, end):
        line = line or _Line(text, start, end)
        i = m.end()
        mark = m.group()
        # A straight quote right behind the mark and in front of a letter opens the next sentence.
        if mark[-1] in "\"'" and i < end and text[i].isalnum() and len(mark) > 1:
            i -= 1
            mark = mark[:-1]
        if i >= end:
            continue
        closed = "closed" if mark[-1] in "\"'”’»›」』）)]】〉》" else "open"
        kind = _kind(mark)
        gap, opening, after, script = _after(text, i, end)
        if after == "end" and not opening:
            continue
        before, number_before = line.before(m.start()) if kind == "stop" else ("", "")
        yield i, (kind, closed, gap, opening, after, script, before, number_before, line.cased)


def labelled_candidates(texts: str = TEXTS) -> tuple[list[tuple], list[int]]:
    keys, labels = [], []
    for line in texts.strip().split("\n"):
        cuts, plain = set(), ""
        for part in line.split("|"):
            plain += part
            cuts.add(len(plain))
        for i, key in candidates(plain, 0, len(plain)):
            keys.append(key)
            labels.append(1 if i in cuts else 0)
    return keys, labels


def fit(texts: str = TEXTS, steps: int = 1500, rate: float = 1.0, penalty: float = 1e-3) -> dict[str, float]:
    """Weights of the maximum-entropy model, by gradient descent on the labelled candidates."""
    keys, labels = labelled_candidates(texts)
    names = {f: i for i, f in enumerate(dict.fromkeys(f for k in keys for f in features(k)))}
    x = np.zeros((len(keys), len(names)))
    for r, k in enumerate(keys):
        x[r, [names[f] for f in features(k)]] = 1
    y, w = np.array(labels, dtype=float), np.zeros(len(names))
    for _ in range(steps):
        w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + penalty * w)
    return dict(zip(names, w.tolist()))


@functools.lru_cache(maxsize=1)
def default_model() -> dict[str, float]:
    return fit()


def _units(text: str, model: dict[str, float], known: dict[tuple, bool]) -> Iterator[tuple[int, int]]:
    at = 0
    breaks = [m.span() for m in _BREAK.finditer(text)]
    for b, e in [*breaks, (len(text), len(text))]:
        cuts = []
        for i, key in candidates(text, at, b):
            verdict = known.get(key)
            if verdict is None:
                verdict = known[key] = sum(model.get(f, 0.0) for f in features(key)) > 0
            if verdict:
                cuts.append(i)
        if not text.isascii():
            cuts += [m.start() for m in _THAI_GAP.finditer(text, at, b)]
            cuts.sort()
        for i in [*cuts, b]:
            piece = text[at:i]
            body = piece.strip()
            if body:
                start = at + len(piece) - len(piece.lstrip())
                yield start, start + len(body)
            at = i
        at = e


def sentence_spans(text: str, model: dict[str, float] | None = None) -> list[tuple[int, int]]:
    return list(_units(text, model or default_model(), {}))


def sentences(df: DataFrame, key: str, text: str, model: dict[str, float] | None = None) -> DataFrame:
    """(key, start_pos, end_pos) of each sentence unit, positions in code points."""
    weights = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, bool] = {}
        for batch in batches:
            rows, starts, ends = [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    for s, e in _units(t, weights, known):
                        rows.append(r)
                        starts.append(s)
                        ends.append(e)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["_key", "start_pos", "end_pos"])

    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    out = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null").mapInArrow(run, schema)
    return out.withColumnRenamed("_key", key)
