"""Personal data spans: strict base patterns plus boosted trees over high-recall candidates.

Base patterns are always reported. On top of them wide generators propose overlapping spans (spelled
out addresses, numbers without a plus, cards and addresses with odd separators), boosted trees judge
each by its format and its context, and a calibrated threshold per kind decides. Nobody has labelled
such spans, so the trees learn from the corpus itself: base matches of a bounded sample of documents,
and the same matches rewritten in the looser formats, are positives; other candidates of the sample that no
longer could be such data, and numbers broken on purpose (bad check digits, parts over 255, plain counts), are negatives.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.llm.boosting import Boosted
from tabmine.llm.common import each_batch, hash_cuts, id_and_text, in_sample

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# no digit before: a later start in the same run of digits can only fail the same way
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, leftmost without overlap within a kind, by kind then start."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((3, *m.span()))
    return found


# Wide generators. Every quantifier is bounded, so they stay linear in the text.
_WIDE = (
    re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}"
        r"(?:\x20?@\x20?|\x20?[\[({]\x20?at\x20?[\])}]\x20?)"
        r"[A-Za-z0-9-]{1,63}(?:(?:\x20?\.\x20?|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}){1,5}",
        re.IGNORECASE,
    ),
    re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]{1,3}){3}(?![0-9])"),
    re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20./_-]{0,2}[0-9]{3,6}){2,4}(?![0-9A-Za-z])"),
    re.compile(r"(?<![0-9A-Za-z(+])(?:\+|00|\(|(?=[0-9]))[0-9]{1,4}(?:[\x20()./-]{1,2}[0-9]{2,8}){1,5}(?![0-9A-Za-z])"),
)
_SPOKEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63}){1,5}", re.IGNORECASE
)
#: Common last labels of host names.
_LAST = frozenset("com org net edu gov int mil info biz io de fr es uk it nl at ch be eu us ca au pl se no dk fi pt".split())
_HINT = (
    re.compile(r"mail|contact|write", re.IGNORECASE),
    re.compile(r"\bip\b|host|server|addr", re.IGNORECASE),
    re.compile(r"card|visa|credit|pay|konto|carte|tarjeta", re.IGNORECASE),
    re.compile(r"phone|\btel|call|mobil|fax|\bcell\b", re.IGNORECASE),
)
_AGAINST = re.compile(r"version|build|isbn|order|invoice|serial|date|\bv[0-9.]*\s*$|token|password", re.IGNORECASE)


def candidates(text: str) -> list[Span]:
    """Overlapping spans from the wide generators, of all kinds."""
    found: list[Span] = []
    if "@" in text or "[" in text or "(" in text or "{" in text:
        found += [(0, *m.span()) for m in _WIDE[0].finditer(text)]
    if " dot " in text or " DOT " in text:
        found += [(0, *m.span()) for m in _SPOKEN.finditer(text)]
    if _DIGIT.search(text):
        found += [(1, *m.span()) for m in _WIDE[1].finditer(text)]
        found += [(2, *m.span()) for m in _WIDE[2].finditer(text) if 13 <= len(_digits(m.group())) <= 19]
        found += [(3, *m.span()) for m in _WIDE[3].finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate. Context is 40 characters before it and one on each side."""
    kind, a, b = span
    s = text[a:b]
    digits = _digits(s)
    before, left, right = text[max(0, a - 40) : a], text[a - 1 : a], text[b : b + 1]
    groups = re.findall("[0-9]+", s)
    separators = {c for c in s if not c.isalnum()}
    return [
        float(len(s)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(len(separators)),
        float(s.startswith("+") or s.startswith("00")),
        float("(" in s),
        float(s.startswith(("0", "(0"))),
        float(re.split("[^a-z]+", s.lower())[-1] in _LAST),
        float(13 <= len(digits) <= 19 and luhn(digits)),
        float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(9 <= len(digits) <= 15),
        float("@" in s),
        float(bool(re.search(r"[A-Za-z]{2,}\W*$", s))),
        float(bool(_HINT[kind].search(before))),
        float(bool(_AGAINST.search(before))),
        float(left.isalnum() or left in ("-", "_", "/", "=", ".", "#")),
        float(right.isalnum() or right in ("_", "/", "%", "€", "$")),
        float(kind),
    ]


def _rewritten(kind: int, s: str, draw: random.Random) -> str:
    """A base match in one of the looser formats that the wide generators cover."""
    if kind == 0:
        at, dot = draw.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), (" [at] ", "."), (" at ", " dot ")])
        local, _, domain = s.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return s.replace(".", draw.choice(["[.]", "(.)", " . "]))
    digits = _digits(s)
    if kind == 2:
        sep = draw.choice(["  ", ".", "/", "_"])
        return sep.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    tail = digits[-10:]
    return draw.choice(["({}) {}-{}", "{}-{}-{}", "00" + digits[:-10] + " {} {} {}", "0{} {}{}", "(0{}) {}{}", "0{}/{}{}"]).format(tail[:3], tail[3:6], tail[6:])


def _broken(kind: int, s: str, draw: random.Random) -> str:
    """Something of the same look that is no personal data."""
    if kind == 0:
        word, n = draw.choice(["look", "meet", "price"]), draw.choice(["3.50", "4.2", "10.00"])
        return draw.choice(["{} ( at ) {}", "{} @ {}", "{} at this dot {}"]).format(word, n.replace(".", " dot ") if draw.random() < 0.3 else n)
    loose = draw.random() < 0.5
    if kind == 1:
        made = ".".join(str(draw.randrange(256, 999)) if k == 2 else str(draw.randrange(0, 999)) for k in range(4))
        return _rewritten(1, made, draw) if loose else made
    digits = _digits(s)
    if kind == 2:
        made = digits[:-1] + str((int(digits[-1]) + draw.randrange(1, 9)) % 10)
        return _rewritten(2, made, draw) if loose else made
    n = lambda a, b: draw.randrange(a, b)
    return draw.choice([
        f"{n(1, 31):02}.{n(1, 13):02}.{n(1900, 2030)}", f"{n(1900, 2030)}-{n(1, 13):02}-{n(1, 31):02} {n(0, 24):02}",
        f"{n(1900, 2030)}/{n(1, 13):02}/{n(1, 31):02}", f"{n(1, 999)} {n(0, 999):03} {n(0, 999):03}", f"{n(1, 99)}.{n(0, 999):03}.{n(0, 999):03}.{n(0, 999):03}",
        f"{n(0, 9999):04}-{n(0, 9999):04}-{n(0, 9999):04}-{n(0, 9999):04}", f"{n(10, 99)} {n(10, 99)} {n(10, 99)} {n(10, 99)}",
        f"{n(1000, 9999)} {n(10000, 999999)}", f"{n(1900, 2030)}/{n(100000, 9999999)}", f"{n(1, 9)} {n(10**7, 10**8 - 1)}",
    ])


def _plausible(kind: int, s: str) -> bool:
    """Whether a natural span could be personal data in a loose format: such ones are no examples of either class."""
    digits = _digits(s)
    if kind == 0:
        return bool(re.search(r"[A-Za-z]{2,}$", s))
    if kind == 1:
        return all(int(g) <= 255 for g in re.findall("[0-9]+", s))
    return luhn(digits) if kind == 2 else s.startswith(("+", "0", "("))


def examples(text: str, per_doc: int = 64, seed: int = 7) -> list[tuple[list[float], float]]:
    """(features, label) of a text's candidates, and of its base spans rewritten and broken; at most ``per_doc``, drawn."""
    draw, out = random.Random(f"{seed}:{zlib.crc32(text.encode('utf-8', 'surrogatepass'))}"), []
    base = base_spans(text)
    taken = set(base)
    for span in candidates(text):
        inside = any(a < span[2] and span[1] < b for _, a, b in base)
        if span in taken or not (inside or _plausible(span[0], text[span[1] : span[2]])):
            out.append((features(text, span), float(span in taken)))
    for kind, a, b in base:
        for made, label in ((_rewritten, 1.0), (_broken, 0.0)):
            new = text[max(0, a - 60) : a] + (s := made(kind, text[a:b], draw)) + text[b : b + 20]
            start = min(60, a)
            for span in candidates(new):
                if span[0] == kind and span[1] < start + len(s) and start < span[2]:
                    whole = abs(span[1] - start) <= 1 and abs(span[2] - start - len(s)) <= 1
                    out.append((features(new, span), label if whole else 0.0))
    return out if len(out) <= per_doc else draw.sample(out, per_doc)


class Judge:
    """Boosted trees with one calibrated threshold per kind."""

    def __init__(self, model: Boosted, cut: list[float]):
        self.model, self.cut = model, cut

    @staticmethod
    def train(texts: list[str], precision: float = 0.99, seed: int = 7) -> Judge:
        """A judge from the examples of some texts."""
        found = [(zlib.crc32(t.encode("utf-8", "surrogatepass")), *e) for t in texts for e in examples(t, seed=seed)]
        return Judge.fit([d for d, _, _ in found], [x for _, x, _ in found], [y for _, _, y in found], precision)

    @staticmethod
    def fit(doc: list[int], x: list[list[float]], y: list[float], precision: float = 0.99) -> Judge:
        """Fit on three quarters of the documents; set each kind's threshold on the others, at ``precision``.

        ``doc`` numbers each example's text, so that equal texts are on one side. Examples of equal score are
        accepted or refused together: the threshold lies midway between two different scores, below the
        last whole tie up to which the precision holds. A kind without such a score adds no spans.
        """
        width = len(features("0", (0, 0, 1)))
        doc, x, y = np.array(doc, dtype=np.int64), np.array(x, dtype=float).reshape(-1, width), np.array(y, dtype=float)
        order = np.lexsort((*x.T, y, doc))  # the same model for any order of the examples
        doc, x, y = doc[order], x[order], y[order]
        held = doc % 4 == 3
        model = Boosted().fit(x[~held], y[~held])
        score, kinds, cut = model.score(x[held]), x[held][:, -1], []
        for kind in range(len(KINDS)):
            p, t = score[kinds == kind], y[held][kinds == kind]
            values, which = np.unique(p, return_inverse=True)
            n, good = np.bincount(which, minlength=len(values))[::-1].cumsum(), np.bincount(which, t, len(values))[::-1].cumsum()
            enough = np.flatnonzero(good >= precision * n) if len(values) else values
            if not len(enough):
                cut.append(1.1)
                continue
            values = np.append(values[::-1], 0.0)
            cut.append(max(0.5, float(values[enough[-1]] + values[enough[-1] + 1]) / 2))
        return Judge(model, cut)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans: base ones plus accepted candidates that touch no span yet."""
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        free = [c for c in candidates(text) if not any(a < c[2] and c[1] < b for a, b in taken)]
        if not free:
            return base, base
        score = self.model.score(np.array([features(text, c) for c in free]))
        added: list[Span] = []
        for p, c in sorted(zip(score.tolist(), free, strict=True), key=lambda z: (-z[0], z[1])):
            if p >= self.cut[c[0]] and not any(a < c[2] and c[1] < b for _, a, b in added):
                added.append(c)
        return base, sorted(base + added)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def train(spark: SparkSession, docs: DataFrame, sample_docs: int = 8000, per_doc: int = 64, precision: float = 0.99) -> Judge:
    """A judge from a bounded sample: the texts of the ``sample_docs`` smallest hashed ids, whole and of any length.

    Tasks turn them into examples, at most ``per_doc`` each, and only those (feature vectors) reach the
    driver. Without examples the judge adds no spans.
    """
    drawn = id_and_text(docs).filter(in_sample(hash_cuts(docs, sample_docs)) & F.col("text").rlike("[0-9@]"))
    out = pa.schema([("doc", pa.int64()), ("x", pa.list_(pa.float64())), ("y", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := examples(text, per_doc):
                    doc = [zlib.crc32(text.encode("utf-8", "surrogatepass"))] * len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip((doc, *zip(*found, strict=True)), out, strict=True)], schema=out)

    made = drawn.mapInArrow(run, "doc long, x array<double>, y double").limit(2 * sample_docs * per_doc).collect()
    return Judge.fit([r.doc for r in made], [r.x for r in made], [r.y for r in made], precision)


def find(spark: SparkSession, docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """Per row doc_id, base counts n_email ... n_phone, base_sha256, spans (all, as text) and n_added.

    Null and empty texts have no spans (base_sha256 is that of the empty string); texts of any length are
    searched whole; repeated rows give repeated rows, an empty table none; other columns are ignored,
    whatever their names. Of overlapping candidates the higher score wins, of equal scores the lower kind,
    then the earlier start, then the earlier end. Offsets are code points, ends exclusive.
    """
    shared = spark.sparkContext.broadcast(judge or train(spark, docs))
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
    out = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in each_batch(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = judge.spans(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            columns = [pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), types[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=out)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return id_and_text(docs).mapInArrow(run, schema)


def redact(spark: SparkSession, docs: DataFrame, judge: Judge | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``text_col`` replaced by its kind in brackets; null texts stay null.

    Of spans that overlap the earlier start counts, of those the longer. All columns and rows stay as
    they are otherwise, in empty tables as in texts of any length.
    """
    shared = spark.sparkContext.broadcast(judge or train(spark, docs.withColumn("text", F.col(text_col))))

    def clean(text):  # a pandas Series of texts
        def one(t):
            if t is None:
                return None
            cut = 0
            parts: list[str] = []
            for kind, a, b in sorted(shared.value.spans(t)[1], key=lambda s: (s[1], -s[2])):
                if a >= cut:
                    parts += [t[cut:a], f"[{KINDS[kind]}]"]
                cut = max(cut, b)
            return "".join(parts) + t[cut:]

        return text.map(one, na_action="ignore")

    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col)))
