"""Source text as rows of tokens: a lexer whose modes nest (code, template strings, tags, text between tags; comments in Rust).

Patterns alone can't tell where a template's part or a tag ends, so this is a scan in Python, over one file at a time and in one pass;
what tokens mean follows from joins and windows over the rows."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODE = re.compile(r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\])*")|(?P<name>(?:[^\W\d]|\$)[\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|->|::|.)""", re.S)
_RUST = re.compile(r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*)|(?P<string>b?r(?P<hashes>#*)".*?"(?P=hashes)|b?"(?:\\.|[^"\\])*"|b?'(?:\\[^'\n]+|[^'\\\n])')|(?P<life>'[^\W\d]\w*)|(?P<name>(?:r#)?[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>=>|->|::|.)""", re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?P<end>`|\$\{|\Z)", re.S)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_TEXT = re.compile(r"[^<{]*")
_ATTRIBUTE = re.compile(r"(?P<space>\s+)|(?P<string>'[^']*'|\"[^\"]*\")|(?P<name>(?:[^\W\d]|\$)[\w$-]*)|(?P<sign>.)", re.S)
#: Words after which an expression begins, so that a slash opens a pattern and an angle a tag.
_BEFORE = frozenset("return typeof case in of delete void throw new else do await yield default".split())
_OPENS = {"(": ")", "[": "]", "{": "}", "${": "}"}
_RUST_COMMENT = re.compile(r"/\*|\*/")
#: Words that go on with a statement on a new line, and those whose brackets wait for a body.
GOES_ON = ("as", "catch", "else", "extends", "finally", "from", "implements", "in", "instanceof", "of", "satisfies", "while")
_HEADERS = ("for", "if", "switch", "while", "with", "catch", "function")
TYPES = ("comment", "name", "number", "string", "sign", "template", "tag", "attribute")
#: Tokens of a part of a script at least.
PART = 4096

SCHEMA = (
    "path string, language string, i int, text string, type string, offset int, line int, col int, last_line int, depth int, paren int, outer int, pair int, within array<int>, part int, "
    "prev string, prev2 string, prev3 string, next string, next2 string, next3 string, prev_line int, prev_type string, next_type string"
)


def _scan(source: str, tags: bool) -> Iterator[tuple[int, str, str]]:
    """offset, text, type of a script's tokens: comment, name, number, string, sign; template and tag for the signs of those, attribute."""
    at, modes, last = 0, [("code", 0)], ("", "sign")
    while at < len(source):
        mode, braces = modes[-1]
        if mode == "template":
            found = _TEMPLATE.match(source, at)
            if found["end"] == "${":
                if len(found[0]) > 2:
                    yield at, found[0][:-2], "string"
                yield found.end() - 2, "${", "template"
                modes.append(("part", 0))
                last = ("${", "template")
            else:
                yield at, found[0], "string"
                modes.pop()
                last = ("`", "string")
            at = found.end()
            continue
        if mode == "text":
            found = _TEXT.match(source, at)
            at = found.end()
            if source.startswith("{", at):
                yield at, "{", "tag"
                modes.append(("part", 0))
                at, last = at + 1, ("{", "tag")
            elif source.startswith("</", at):
                yield at, "</", "tag"
                modes[-1] = ("closing", 0)
                at += 2
            elif at < len(source):
                yield at, "<", "tag"
                modes.append(("opening", 1))
                at += 1
            continue
        if mode in ("opening", "closing"):
            found = _ATTRIBUTE.match(source, at)
            kind, text, at = found.lastgroup, found[0], found.end()
            if kind == "space":
                continue
            if text == "{":
                modes.append(("part", 0))
                last = ("{", "tag")
            elif text == ">":
                modes.pop()
                if mode == "opening" and last[0] != "/":
                    modes.append(("text", 0))
                last = (")", "sign")
            elif mode == "opening" and kind == "name" and not braces:
                kind = "attribute"
            if text not in (".", ">") and kind != "space":
                modes[-1] = (modes[-1][0], 0) if modes[-1][0] == mode else modes[-1]
                last = last if text in "{>" else (text, "tag")
            elif text == "." and mode == "opening":
                modes[-1] = ("opening", 1)
            yield found.start(), text, "tag" if kind == "sign" else kind
            continue
        found = _CODE.match(source, at)
        kind, text = found.lastgroup, found[0]
        if kind == "sign":
            begins = last[1] in ("sign", "template", "tag") and last[0] not in (")", "]", "}") or last[0] in _BEFORE and last[1] == "name"
            if text == "`":
                modes.append(("template", 0))
                found = None
                yield at, "`", "template"
                at += 1
                continue
            if text == "/" and begins and (pattern := _PATTERN.match(source, at)):
                found, kind, text = pattern, "string", pattern[0]
            elif text == "<" and tags and begins and re.match(r"<(?:[^\W\d]|>)(?!\w*\s*(?:,|extends\b))", source[at : at + 80]):
                yield at, "<", "tag"
                modes.append(("opening", 1))
                at, last = at + 1, ("<", "tag")
                continue
            elif text == "{":
                modes[-1] = (mode, braces + 1)
            elif text == "}":
                if mode == "part" and not braces:
                    modes.pop()
                    yield at, "}", "template" if modes[-1][0] == "template" else "tag"
                    at, last = at + 1, ("}", "tag")
                    continue
                modes[-1] = (mode, max(0, braces - 1))
        if kind != "space":
            yield at, text, kind
            if kind != "comment":
                last = (text, kind)
        at = found.end()


def _scan_rust(source: str) -> Iterator[tuple[int, str, str]]:
    at = 0
    while at < len(source):
        found = _RUST.match(source, at)
        kind, text, end = found.lastgroup, found[0], found.end()
        if text == "/*":  # comments nest
            open_ = 1
            for sign in _RUST_COMMENT.finditer(source, end):
                open_ += 1 if sign[0] == "/*" else -1
                if not open_:
                    break
            end = sign.end() if end < len(source) and _RUST_COMMENT.search(source, end) and not open_ else len(source)
            text = source[at:end]
        if kind != "space":
            yield at, text, {"life": "sign", "hashes": "string"}.get(kind, kind)
        at = end


def _sliced(source: str, path: str, language: str) -> tuple[array, array, bytearray, array]:
    """Offsets, ends, types (places in TYPES) and partners (-1: none) of a file's tokens: 13 bytes a token, however large the file is."""
    scan = _scan_rust(source) if language == "rust" else _scan(source, not path.endswith((".ts", ".mts", ".cts")))
    offsets, ends, types, pairs, around = array("i"), array("i"), bytearray(), array("i"), []
    for i, (offset, text, kind) in enumerate(scan):
        offsets.append(offset)
        ends.append(offset + len(text))
        types.append(TYPES.index(kind))
        pairs.append(-1)
        if kind in ("sign", "template", "tag"):
            key = (text, kind == "sign")
            if text in ")]}" and any(closed == key for _, closed in around):
                pair, closed = around.pop()
                while closed != key:  # brackets that were never closed end here
                    pair, closed = around.pop()
                pairs[i], pairs[pair] = pair, i
            if text in _OPENS:
                around.append((i, (_OPENS[text], kind == "sign")))
    return offsets, ends, types, pairs


def _cuts(tokens: Iterator[tuple[str, str, str | None, bool]], least: int) -> Iterator[int]:
    """For each of a script's tokens (text, type, the next one's text, whether it is at the top level): the part it is in. A part ends, after `least` tokens,
    before a name at the top level that begins a statement, where nothing before it waits for what comes: neither an arrow's expression for
    its end nor a header for its body. So what operators.scopes tells within a part is what it would tell within the file."""
    part = n = 0
    arrow = body = False
    last = ("", "")
    for text, kind, follows, top in tokens:
        if top:
            if n >= least and not arrow and not body and kind == "name" and text not in GOES_ON and last in ((";", "sign"), ("}", "sign")):
                part, n = part + 1, 0
            if text == "=>":
                arrow = follows != "{"
            elif text in (",", ";"):
                arrow = False
            if text == "{":
                body = False
            elif text in _HEADERS or text == ":" and last[0] == ")":
                body = True
            last = (text, kind)
        n += 1
        yield part


def rows(path: str, source: str, language: str, least: int = PART) -> list[tuple]:
    return list(_rows(path, source, language, least))


def _rows(path: str, source: str, language: str, least: int = PART) -> Iterator[tuple]:
    """A file's tokens: place, text, type, offset, line (from 1), col (from 0), last line, open braces and other brackets around it, the places of
    the innermost bracket around it (-1: none) and of a bracket's partner (-1: none), all brackets around it, outermost first; its part (of
    scripts, see _cuts); text, type and last line of the tokens beside it, comments apart.

    Partners are found in a first pass, so that no file's rows are held at once."""
    offsets, ends, types, pairs = _sliced(source, path, language)
    code = array("i", (i for i, kind in enumerate(types) if TYPES[kind] != "comment"))
    at = lambda c: source[offsets[code[c]] : ends[code[c]]] if c < len(code) else None
    around, line, line_at, upto, depth, paren, c = [], 1, 0, 0, 0, 0, -1
    near, before = (None, None, None, None, at(0), at(1), at(2)), (None, None)
    told = []  # what _cuts reads
    parts = _cuts(iter(told.pop, None), least)
    for i, offset in enumerate(offsets):
        text, kind, pair = source[offset : ends[i]], TYPES[types[i]], pairs[i]
        line_end = source.count("\n", upto, offset)
        if line_end:
            line, line_at = line + line_end, source.rfind("\n", 0, offset) + 1
        upto = offset
        if -1 < pair < i:
            while True:
                last = around.pop()
                if TYPES[types[last]] == "sign":
                    depth, paren = (depth - 1, paren) if source[offsets[last]] == "{" else (depth, paren - 1)
                if last == pair:
                    break
        ends_at, beside, part = line + text.count("\n"), (None,) * 9, 0
        if kind != "comment":
            c += 1
            near = (*near[1:], at(c + 3))
            p3, p2, p1, _, n1, n2, n3 = near
            beside = (p1, p2, p3, n1, n2, n3, *before, TYPES[types[code[c + 1]]] if c + 1 < len(code) else None)
            before = (ends_at, kind)
            if language != "rust":
                told.append((text, kind, n1, not around))
                part = next(parts)
        yield (path, language, i, text, kind, offset, line, offset - line_at, ends_at, depth, paren, around[-1] if around else -1, pair, list(around), part, *beside)
        if kind in ("sign", "template", "tag") and text in _OPENS:
            around.append(i)
            if kind == "sign":
                depth, paren = (depth + 1, paren) if text == "{" else (depth, paren + 1)


def _lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in SCHEMA.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            path, source, language = (batch.column(i)[k].as_py() for i in range(3))
            found = _rows(path, source or "", language)
            while part := list(islice(found, 1 << 13)):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), types, strict=True)], names)


def pieces(files: DataFrame) -> int:
    """Partitions for these files' tokens: so many that one has about a MB of source, and no fewer than the session's shuffles have."""
    total = files.agg(F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()[0]
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), total >> 20)


def lexed(files: DataFrame, n: int | None = None) -> DataFrame:
    """files(path, source, language) -> a row for each token (SCHEMA), from n tasks: few large files would else share one."""
    files = files.select("path", "source", "language")
    return files.repartition(n or pieces(files)).mapInArrow(_lexed, SCHEMA)
