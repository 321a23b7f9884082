"""Secret scan: base patterns, and an assignment-aware lexer over source and configuration syntax.

The lexer reads a text once. First it finds what is quoted: strings (plain, triple, back-quoted), comments, here
documents and block scalars, and blanks their inside, so that nothing in them is taken for syntax. Then it cuts the
rest into name-literal pairs (`name = "literal"`, `"name": literal`, `name: type = literal`, `export name=literal`,
`name := a + b`, `table["name"] = literal`), with scopes of braces, of functions by indentation and of nested keys. It
carries constants through names that are assigned from other names or joined with `+`, and scores each literal by how
sensitive the names are that it reaches. Strings and comments that hold assignments themselves are read as texts of
their own, to any depth, whose names don't get out. Every step is linear in the text's length.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

#: Where something quoted may begin: strings, comments, here documents, block scalars.
_QUOTED = re.compile(r"""\"\"\"|'''|"|(?<![A-Za-z0-9_])'|`|(?<!\S)#|(?<![:\\/A-Za-z0-9])//|/\*|<!--|(?<!\S)--(?=[\x20\t])|^[\x20\t]*+;|<<[-~]?["']?[A-Za-z_][A-Za-z0-9_]*+|(?<=:)[\x20\t]++[|>][-+0-9]{0,2}[\x20\t]*+(?=\n)""", re.MULTILINE)
_INSIDE = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+{q}") for q in "\"'`"}
_CLOSERS = {"/*": "*/", "<!--": "-->"}
#: In the blanked text a string is a mark for its opening quote, fillers and a mark for its closing one.
_OPEN, _FILL, _CLOSE = "\x02", "\x01", "\x03"
_CLEAR = str.maketrans("\x01\x02\x03", "   ")
_NAME = r"(?<![A-Za-z0-9_$.\-])[A-Za-z_$][A-Za-z0-9_$.\-]*+"
_STRING = r"\x02\x01*+\x03"
_VALUE = rf"(?:[rbufRBUF]{{0,2}}{_STRING}|\$\{{[A-Za-z_][A-Za-z0-9_]*+\}}|[A-Za-z0-9+/_.=\-$@]++)"
#: A pair, the opening of a nested table, a brace, a function's head, a key over an indented block.
_EVENT = re.compile(rf"""(?P<def>^(?P<inset>[\x20\t]*+)(?:async[\x20]++)?(?:def|class)[\x20\t])|(?P<over>^(?P<indent>[\x20\t]*+)(?:-[\x20])?(?P<key>[A-Za-z_][A-Za-z0-9_.\-]*+|{_STRING})[\x20\t]*+:[\x20\t]*+$)|(?P<name>{_NAME}|{_STRING})\]?[\x20\t]*+(?:(?::[\x20\t]*+(?P<type>[A-Za-z_][A-Za-z0-9_.\[\]|]*+)[\x20\t]*+)?=(?![=~>])|:=|=>|\?\?=|:(?![:/]))[\x20\t]*+(?:(?P<values>{_VALUE}(?:[\x20\t]*+\+[\x20\t]*+{_VALUE})*+)(?P<after>[(\[]?)|(?P<table>\{{))|(?P<brace>[{{}}])""", re.ASCII | re.MULTILINE)
_OPERAND = re.compile(_VALUE, re.ASCII)
_CALLED = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*", re.ASCII)
#: Names that say nothing of what they hold: the key over them does.
NEUTRAL = frozenset(("value", "val", "data", "default", "text", "content", "string", "raw", "plain", "current"))
#: Parts of names and how sensitive they are; a name's own score is the highest of its parts.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 0.9, "accesskey": 0.9, "privatekey": 1.0, "secretkey": 1.0, "encryptionkey": 1.0, "decryptionkey": 1.0, "signingkey": 1.0, "masterkey": 1.0, "sshkey": 0.9, "clientkey": 0.9, "clientcert": 0.7, "privatecert": 0.9, "pincode": 0.7, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "key": 0.4, "salt": 0.5, "cert": 0.4, "pin": 0.4}
#: A literal is reported from this score up; shorter literals and those with less entropy never are.
THRESHOLD, MIN_LENGTH, MIN_ENTROPY = 0.5, 6, 1.5
#: Length and entropy from which a literal of letters and digits looks random. A weak name (a weight below THRESHOLD) then has that weight; so has `pin` before digits alone.
RANDOM_LENGTH, RANDOM_ENTROPY = 12, 3.0
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|none|null|true|false|undefined|changeme|example|your[_\-].*|<.*>|\$\{.*\}|%.*%)$", re.IGNORECASE)


def _words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]


@lru_cache(1 << 14)
def name_score(name: str) -> float:
    """The sensitivity of a name's words: snake, kebab, dotted and camel case are split, neighbours also joined."""
    words = _words(name)
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *("".join(p) for p in zip(words, words[1:], strict=False))]), default=0.0)


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def looks_random(word: str, name: str) -> bool:
    if word.isdigit():
        return "pin" in _words(name)
    return len(word) >= RANDOM_LENGTH and entropy(word) >= RANDOM_ENTROPY and bool(re.search(r"[0-9]", word) and re.search(r"[A-Za-z]", word) and re.fullmatch(r"[A-Za-z0-9+/_=\-]+", word))


def blanked(text: str, flat: bool = False) -> tuple[str, dict[int, tuple[int, int]], list[tuple[int, int]]]:
    """(the text with the inside of all that is quoted blanked, the span of each string's inside by where it begins, spans to read as texts of their own). flat: line comments, here documents and block scalars are read in place."""
    out: list[str] = []
    strings: dict[int, tuple[int, int]] = {}
    inner: list[tuple[int, int]] = []
    text = text.translate(_CLEAR)
    done, at, n = 0, 0, len(text)
    dead = dict.fromkeys("\"'`", -1)  # up to where a quote is known to have no end on its line
    missing: set[str] = set()
    ends: dict[str, list[int]] | None = None

    def string(start: int, a: int, b: int, end: int) -> None:
        nonlocal done, at
        out.append(text[done:start])
        out.append(_OPEN + _FILL * (end - start - 2) + _CLOSE)
        strings[start] = a, b
        inner.append((a, b))
        done = at = end

    def comment(start: int, a: int, end: int) -> None:
        nonlocal done, at
        out.append(text[done:start])
        out.append(" " * (end - start))
        inner.append((a, end))
        done = at = end

    while m := _QUOTED.search(text, at):
        start, at, what = m.start(), m.end(), m[0]
        if what in dead:
            if start < dead[what]:
                continue
            if found := _INSIDE[what].match(text, at):
                string(start, at, found.end() - 1, found.end())
            else:
                end = text.find("\n", at)
                dead[what] = n if end < 0 else end
        elif len(what) == 3 and what[0] in "\"'":
            end = text.find(what, at)
            if end >= 0:
                string(start, at, end, end + 3)
            elif what[0] in dead:  # an empty string, then a quote: the rest of the text has no such end
                string(start, start + 1, start + 1, start + 2)
        elif what in _CLOSERS:
            end = -1 if what in missing else text.find(_CLOSERS[what], at)
            if end < 0:
                missing.add(what)
            else:
                comment(start, at, end + len(_CLOSERS[what]))
        elif flat and what[0] not in "\"'`":
            out.append(text[done:start])
            out.append(" " * (at - start))
            done = at
        elif what.startswith("<<"):
            if ends is None:
                ends, where = {}, 0
                for line in text.split("\n"):
                    ends.setdefault(line.strip(), []).append(where)
                    where += len(line) + 1
            body = text.find("\n", at) + 1
            stops = ends.get(what.lstrip("<-~\"'"), [])
            k = bisect.bisect_left(stops, body) if body else len(stops)
            if k < len(stops):
                out.append(text[done:start])
                out.append(_OPEN + _FILL * (at - start - 2) + _CLOSE)
                strings[start] = body, max(body, stops[k] - 1)
                line = text[at:body]
                out.append(line)
                comment_end = stops[k]
                out.append(" " * (comment_end - body))
                inner.append((body, comment_end))
                done = at = comment_end
        elif what.strip()[0] in "|>":
            margin = text.rfind("\n", 0, start) + 1
            depth = len(text[margin:start]) - len(text[margin:start].lstrip(" "))
            first = end = at + 1
            while end < n:
                stop = text.find("\n", end)
                stop = n if stop < 0 else stop
                line = text[end:stop]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= depth:
                    break
                end = min(n, stop + 1)
            body = text[first:end]
            a, b = first + len(body) - len(body.lstrip()), first + len(body.rstrip())
            if b > a and len(what) >= 2:
                out.append(text[done:start])
                out.append(_OPEN + _FILL * (len(what) - 2) + _CLOSE + "\n" + " " * (end - first))
                strings[start] = a, b
                inner.append((a, b))
                done = at = end
        else:
            end = text.find("\n", at)
            comment(start, at, n if end < 0 else end)
    out.append(text[done:])
    return "".join(out), strings, inner


class Scopes:
    """Names and what they hold, by scope: a name that an open scope has is that one, a new name belongs to the innermost. So a name is held once at a time, and is found at once however deep it lies."""

    def __init__(self):
        self.stack: list[tuple[int, str, list | None]] = [(-1, "", [])]  # indent (-1: braces), key over it, its own names
        self.names: dict = {}
        self.inner, self.braces = [0], 0  # places of the scopes that have names; scopes of braces

    def push(self, indent: int, key: str, names: bool) -> None:
        self.braces += indent < 0
        if names:
            self.inner.append(len(self.stack))
        self.stack.append((indent, key, [] if names else None))

    def _pop(self) -> int:
        indent, _, names = self.stack.pop()
        if names is not None:
            self.inner.pop()
            for name in names:
                del self.names[name]
        self.braces -= indent < 0
        return indent

    def dedent(self, indent: int) -> None:
        while self.stack[-1][0] >= indent >= 0:
            self._pop()

    def close(self) -> None:
        """A closing brace: the scopes by indentation inside go too."""
        while self.braces and self._pop() >= 0:
            pass

    def holds(self, name: str):
        return self.names.get(name)

    def put(self, name: str, value) -> None:
        if name not in self.names:
            self.stack[self.inner[-1]][2].append(name)
        self.names[name] = value

    def key(self) -> str:
        return self.stack[-1][1]


def assignments(text: str, flat: bool = False):
    """(target names, name, [(operand, start, end, quoted)], scopes) of a text's assignments in order, and scopes as they are there. Spans leave out the quotes. Also the spans to read as texts of their own."""
    skeleton, strings, inner = blanked(text, flat)

    def inside(at: int, end: int) -> tuple[str, int, int, bool]:
        opening = skeleton.find(_OPEN, at, end)
        if opening < 0:
            return text[at:end], at, end, False
        a, b = strings[opening]
        return text[a:b], a, b, True

    scopes = Scopes()

    def run():
        last = 0
        for m in _EVENT.finditer(skeleton):
            if (begin := skeleton.rfind("\n", last, m.start()) + 1) or not last:
                scopes.dedent(len(m["inset"] or m["indent"] or "") if m["def"] or m["over"] else _inset(skeleton, begin, m.start()))
            last = m.end()
            if m["brace"]:
                scopes.push(-1, "", True) if m["brace"] == "{" else scopes.close()
            elif m["def"]:
                scopes.push(len(m["inset"]), "", True)
            elif m["over"]:
                scopes.push(len(m["indent"]), inside(*m.span("key"))[0], False)
            else:
                name = inside(*m.span("name"))[0]
                if m["table"]:
                    scopes.push(-1, name, True)
                    continue
                values = m["values"]
                if _OPEN in values or "+" in values:
                    operands = [inside(*o.span()) for o in _OPERAND.finditer(skeleton, *m.span("values"))]
                else:
                    operands = [(values, *m.span("values"), False)]
                if m["after"] and not operands[-1][3] and _CALLED.fullmatch(operands[-1][0]):
                    operands.pop()  # a call or an element: what it gives is not known
                yield name, operands, scopes
                if m["type"]:  # `name: type = literal`, or some words and a colon before `name = literal`
                    yield m["type"], operands, scopes

    return run(), inner


def _inset(text: str, begin: int, end: int) -> int:
    lead = text[begin:end]
    return len(lead) - len(lead.lstrip(" \t-"))


def lex(text: str) -> list[tuple[str, list[tuple[str, int, int, bool]]]]:
    """[(name, [(operand, start, end, quoted)])] of a text's assignments, in order."""
    return [(name, operands) for name, operands, _ in assignments(text)[0]]


def _bare(word: str) -> str:
    """The name that a bare word may be: shell's marks go."""
    return word.strip("${}") if word.startswith("$") else word


def _reach(text: str, held, weight: float, name: str, best: dict) -> None:
    """Scores all literals of what a sensitive name holds. What a name of that weight has reached before is left out, so all calls together take time linear in the text."""
    mark, todo = (weight, "pin" in _words(name)), [held]
    while todo:
        spans, made_from, reached = todo.pop()
        if mark in reached:
            continue
        reached.add(mark)
        todo += made_from
        for start, end in spans:
            word = text[start:end]
            if len(word) >= MIN_LENGTH and not _PLACEHOLDER.match(word):
                bits = entropy(word)
                sure = max(weight, THRESHOLD) if weight < THRESHOLD and looks_random(word, name) else weight
                score = sure * min(1.0, 0.4 + bits / 5 + 0.2 * bool(re.search(r"[0-9]", word)))
                if bits >= MIN_ENTROPY and score >= THRESHOLD and score > best.get((start, end), (0.0, ""))[0]:
                    best[start, end] = (score, name)


#: Texts within texts that are read as the outermost one is. Deeper ones are read in place as far as they may be nested without end, so a text takes linear time and none is left out.
NESTED = 6


def literals(text: str) -> list[tuple[int, int, float, str]]:
    """(start, end, score, name) of the literals that reach sensitive names. A name holds the literals last assigned to it; a bare word that is such a name passes them on. A name that says nothing has the name of the key over it. What is quoted in the text, and in that, is read in turn."""
    best: dict[tuple[int, int], tuple[float, str]] = {}
    todo = [(0, len(text), 0)]
    while todo:
        at, end, depth = todo.pop()
        part = text[at:end] if depth else text
        if "=" not in part and ":" not in part:
            continue
        found: dict[tuple[int, int], tuple[float, str]] = {}
        todo += [(at + a, at + b, depth + 1) for a, b in _read(part, found, depth >= NESTED)]
        for (a, b), (score, name) in found.items():
            if score > best.get((at + a, at + b), (0.0, ""))[0]:
                best[at + a, at + b] = (score, name)
    return [(a, b, s, n) for (a, b), (s, n) in sorted(best.items())]


def _read(text: str, best: dict, flat: bool) -> list[tuple[int, int]]:
    """Scores a text's own literals; returns the spans to be read next."""
    pairs, inner = assignments(text, flat)
    for name, operands, scopes in pairs:
        # What a name holds: own literals, what the names hold that it was made from, and the weights that reached all of it.
        spans, made_from = [], []
        for word, start, end, quoted in operands:
            held = None if quoted else scopes.holds(_bare(word))
            if held is not None:
                made_from.append(held)
            else:
                spans.append((start, end))
        held = made_from[0] if len(made_from) == 1 and not spans else (spans, made_from, set())
        scopes.put(name, held)
        judged = scopes.key() if name.lower() in NEUTRAL and scopes.key() else name
        if weight := name_score(judged):
            _reach(text, held, weight, judged, best)
    return inner


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted; offsets are code points."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end) in order of start, then kind."""
    base = base_spans(text)
    found = [(a, 3, b) for a, b, _, _ in literals(text)] if "=" in text or ":" in text else []
    return base, sorted([*base, *found])


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: counts of the base patterns, the digest of their spans, and all spans as text.

    Whole texts are read, in time linear in their length, however deep they are nested; a null or empty text has no
    spans. Spans are code points, the end exclusive. Repeated rows are judged alike; an empty table gives an empty
    result; further columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(text: str):
        base, spans = scan(text)
        counts = Counter(k for _, k, _ in base)
        return counts[0], counts[1], counts[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

    def run(batches):
        for batch in batches:
            cols = list(zip(*map(one, texts_of(batch.column(1))), strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    return secret_spans(table(spark, sf_dir, "documents"))
