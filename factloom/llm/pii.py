"""Personal data in whole texts, plain and disguised, with spans of the source's code points.

Plain identifiers are found on the source itself. For disguises a transducer rewrites the text into a normal form and
records for every character written the source span it stands for: homoglyphs and full-width forms become ASCII,
spelled digits become digits, `(at)`, `[dot]`, ` at ` ... ` dot ` become @ and a full stop, zero-width characters go.
Identifiers found in the normal form are mapped back to the source, unless a plain span already covers or crosses them.

Defined cases: a null or empty text has no span; spans of one kind never overlap; a disguised span is dropped
if it overlaps a plain one, or an earlier disguised one, without holding it and more; plain results never change; repeated rows are each worked on;
all columns of the input are kept, and those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._shared import small_batches

Span = tuple[str, int, int]
#: Fixed values of the contract: the kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_RUN = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As the pattern finds them, but each search begins at an @ and takes the characters before it."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield "email", start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str, at: int) -> Iterator[Span]:
    """As the pattern finds them: four runs of digits with a full stop between, each run walked once. A match in the midst
    of a run can't be: the leftmost begins with the run."""
    chain: list[tuple[int, int]] = []
    for m in _RUN.finditer(text, at):
        if chain and not (m.start() == chain[-1][1] + 1 and text[chain[-1][1]] == "."):
            chain.clear()
        chain.append(m.span())
        if len(chain) == 4:
            if all(e - s <= 3 or not text[s : e - 3].strip("0") for s, e in chain) and all(int(text[max(s, e - 3) : e]) <= 255 for s, e in chain):
                yield "ip", chain[0][0], chain[3][1]
            chain.clear()  # those that fail are used up too


def plain(text: str) -> list[Span]:
    """The contract's identifiers, by kind as listed and then by start."""
    out = list(_emails(text)) if "@" in text else []
    first = _DIGIT.search(text)
    if not first:
        return out
    since = first.start()
    out += _ips(text, since)
    for m in _CARD.finditer(text, since):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


#: Look-alikes of Cyrillic and Greek letters, and typographic signs, as ASCII.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρ", "aeopcyxijsdhlqwABEKMHOPCTXIJSABEZHIKMNOPTYXaovp", strict=True))
SIGNS = dict(zip("\u2010\u2011\u2012\u2013\uff0e\u3002\u2024\ufe52\ufe6b\u00a0\u2007\u202f", "----....@   ", strict=True))
#: Full-width forms are ASCII moved by a fixed distance.
HOMOGLYPHS = LOOK_ALIKE | SIGNS | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
#: Characters without width, and the digits' names.
NO_WIDTH = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + NO_WIDTH + "]")
_NAME = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
#: A run of at least four spelled or single digits of which one at least is spelled.
_DIGITS = re.compile(rf"(?<![A-Za-z0-9])(?:{_NAME}|[0-9]+)(?:[\x20.-]{{1,2}}(?:{_NAME}|[0-9]+)){{3,}}(?![A-Za-z0-9])", re.IGNORECASE)
_ONE = re.compile(rf"{_NAME}|[0-9]+|[^A-Za-z0-9]+", re.IGNORECASE)
_SPELLS = re.compile(_NAME, re.IGNORECASE)
#: Bracketed signs stand for themselves; bare words only between what looks like a mailbox and a domain.
_SIGN = r"\x20?(?:\[\x20?{0}\x20?\]|\(\x20?{0}\x20?\)|\{{\x20?{0}\x20?\}}|<\x20?{0}\x20?>)\x20?"
_AT, _DOT = _SIGN.format("(?:at|@)"), _SIGN.format(r"(?:dot|\.)")
_MAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:(?:{_DOT}|\x20dot\x20|\.)[A-Za-z0-9_%+-]+){{0,4}}"
    rf"(?:{_AT}|\x20at\x20|\x20?@\x20?)[A-Za-z0-9-]+(?:(?:{_DOT}|\x20dot\x20|\.)[A-Za-z0-9-]+){{1,5}}(?![A-Za-z0-9-])",
    re.IGNORECASE,
)
#: Ends of domains that a bare "dot" may stand before.
_ENDS = frozenset("com org net edu gov mil int info biz io co dev app me tv ai eu us uk ca au nz de fr es it nl be ch se no fi dk pl pt br mx ar jp cn kr in ru".split())
_MAIL_PART = re.compile(rf"({_AT}|\x20at\x20|\x20?@\x20?)|({_DOT}|\x20dot\x20)", re.IGNORECASE)
_HINT = re.compile(r"[\[({<]\x20?(?:at|dot|@|\.)\x20?[\])}>]|\x20dot\x20", re.IGNORECASE)
_DOTTED = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT}|\x20dot\x20|\.)[0-9]{{1,3}}){{3}}(?![0-9.])", re.IGNORECASE)


class _Tape:
    """A text with, for each character, the source span that it stands for."""

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range):
        self.text, self.starts, self.ends = text, starts, ends

    def rewritten(self, edits: list[tuple[int, int, str]]) -> _Tape:
        """With each (start, end, new) replaced, in order; the characters of new stand for the whole span."""
        parts, starts, ends, at = [], [], [], 0
        for lo, hi, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:lo], new]
            starts += self.starts[at:lo]
            ends += self.ends[at:lo]
            if hi > lo:
                starts += [self.starts[lo]] * len(new)
                ends += [self.ends[hi - 1]] * len(new)
            at = hi
        return _Tape("".join(parts), starts, ends)


def _normal(text: str) -> _Tape | None:
    """The normal form; None where nothing is disguised."""
    tape, changed = _Tape(text, range(len(text)), range(1, len(text) + 1)), False
    if not text.isascii():
        odd = [(m.start(), m.end(), HOMOGLYPHS.get(m[0], "")) for m in _ODD.finditer(text)]
        if odd:
            tape, changed = tape.rewritten(odd), True
    if _SPELLS.search(tape.text):
        edits = []
        for m in _DIGITS.finditer(tape.text):
            if not _SPELLS.search(m[0]):
                continue
            for part in _ONE.finditer(m[0]):
                new = SPELLED.get(part[0].lower())
                if new is not None:
                    edits.append((m.start() + part.start(), m.start() + part.end(), new))
                elif not part[0].isalnum():  # separators of spelled digits go, but for dots
                    edits.append((m.start() + part.start(), m.start() + part.end(), "." if "." in part[0] else ""))
        if edits:
            tape, changed = tape.rewritten(edits), True
    if _HINT.search(tape.text) or " @" in tape.text or "@ " in tape.text:
        edits = []
        for m in _MAIL.finditer(tape.text):
            parts = [(m.start() + p.start(), m.start() + p.end(), "@" if p[1] else ".") for p in _MAIL_PART.finditer(m[0])]
            bare = re.search(r"\x20(?:at|dot)\x20", m[0], re.IGNORECASE)
            last = re.search(r"[A-Za-z0-9-]*$", m[0])[0].lower()
            if not bare or last in _ENDS and any(new == "." for _, _, new in parts):  # prose has bare words too
                edits += parts
        taken = [(a, b) for a, b, _ in edits]
        for m in _DOTTED.finditer(tape.text):
            edits += [(m.start() + p.start(), m.start() + p.end(), ".") for p in re.finditer(rf"{_DOT}|\x20dot\x20", m[0], re.IGNORECASE) if (m.start() + p.start(), m.start() + p.end()) not in taken]
        if edits:
            tape, changed = tape.rewritten(sorted(edits)), True
    return tape if changed else None


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """The plain spans, and the disguised ones besides, each by kind as listed and then by start."""
    if not text:
        return [], []
    base = plain(text)
    tape = _normal(text)
    more: list[Span] = []
    if tape is not None:
        taken = sorted((s, e) for _, s, e in base)
        for kind, lo, hi in plain(tape.text):
            start, end = tape.starts[lo], tape.ends[hi - 1]
            if all(start <= s and e <= end and (s, e) != (start, end) for s, e in taken if s < end and start < e):
                more.append((kind, start, end))
                taken.append((start, end))
    return base, more


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _arrow(lists: list[list[Span]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in lists], kind)


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with base_spans and more_spans, arrays of (kind, start, end) in code points, ends exclusive."""
    small_batches(docs.sparkSession)
    docs = docs.drop("base_spans", "more_spans").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("base_spans", SPANS), T.StructField("more_spans", SPANS)])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            found = [find(x) for x in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, _arrow([b for b, _ in found]), _arrow([m for _, m in found])], names=schema.names)

    return docs.mapInArrow(batches, schema)


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets, and n_chars, where there is one, counted anew."""
    small_batches(docs.sparkSession)
    docs = docs.withColumn("text", F.col("text").cast("string"))

    def mask(text: str | None) -> str | None:
        base, more = find(text)
        out, at = [], 0
        for kind, start, end in sorted([*base, *more], key=lambda x: (x[1], -x[2])):
            if start >= at:
                out += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in it:
            text = pa.array([mask(x) for x in rows.column("text").to_pylist()], rows.schema.field("text").type)
            yield rows.set_column(rows.schema.names.index("text"), rows.schema.field("text"), text)

    out = docs.mapInArrow(batches, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of plain spans of each kind, base_sha256 over them, and spans: all, by kind as listed, then start."""
    out = with_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("base_spans", "more_spans")
    of_kind = lambda kind: F.array_sort(F.filter(every, lambda s: s["kind"] == kind))
    ordered = F.flatten(F.array(*map(of_kind, KINDS)))
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(ordered).alias("spans"))
