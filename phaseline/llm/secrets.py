"""Secrets in texts: fixed patterns, and literals assigned to sensitive names.

The base patterns find assignments, access keys and long hexadecimal runs
wherever they stand.  The lexer reads the text as source or configuration
into pairs of a name and its literals:

* assignments: ``name = ".."``, ``:``, ``:=``, ``=>``, ``<-``, ``?=``, ``+=``, with a type
  (``name: str = ".."``, ``const name string = ".."``), several names (``a, b = ".."``, item by
  item; ``a = b = ".."``), keyword arguments, quoted keys, and the value on the next line, in
  brackets, joined by ``+``, or in neighbouring quotes;
* calls that name what they set or get: ``define("NAME", "..")``, ``get("name", "..")``;
* markup: ``<name>..</name>``, attributes, and ``key="name" value=".."`` of one tag;
* YAML blocks (``name: |``), and ``name:`` followed by ``value:``, in JSON too.

A right side that is itself a name is replaced by the literals that it stands for, through
any number of steps, so a constant is judged by every name it reaches.  Names are
looked up in the scopes around (deeper braces or indents are inner scopes): an inner
assignment doesn't change an outer name, and is seen outside only where nothing else
has its name.  A pair scores by how sensitive its name's words are and by how much its
literal, its escapes decoded, looks like a secret; from ``LEAST_SCORE`` on it is found.

A span inside an assignment that a base pattern already found is not repeated.

Defined cases: a null text is read as empty and has no findings; texts are read
whole, never in windows, however long, in time that grows with their length; of
names that a literal reaches the most sensitive counts, the first on a tie; null
keys and repeated rows keep their rows; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal", "constant")
# fixed patterns of the base findings; those of repeated classes take whole runs
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Weights of the words of a name, and words that make it harmless.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "pw": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3, "cred": 2, "creds": 2, "auth": 1, "private": 1, "access": 1, "api": 1, "key": 1, "signing": 1, "bearer": 2}
HARMLESS = {"count", "length", "len", "size", "max", "min", "limit", "type", "name", "path", "file", "url", "field", "label", "expires", "expiry", "index", "public", "hint"}
PLACEHOLDERS = {"true", "false", "null", "none", "nil", "undefined", "changeme", "example", "placeholder", "redacted", "todo", "password", "secret", "token"}
LEAST_SCORE = 4.0

#: Every name that scores holds one of these words, and a constant counts only once it reaches such a name,
#: so a text without any of them has no pair to judge.
_HINT = re.compile("|".join(sorted(SENSITIVE)), re.I)
_NAME = r"[A-Za-z_$][\w$.-]*+"
_TRIPLE = r"""\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}"""
_QUOTED = _TRIPLE + r"""|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`"""
#: A literal, after the letters that some languages put before it, and a word without quotes.
_STRING = re.compile(rf"[rRbBuUfF@$]{{0,2}}({_QUOTED})")
_BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>+]++""")
_OPERATOR = r":=|=>|<-|[?+]?=(?!=)|:(?![:/=])"
#: What begins a pair, or ends a scope: a name with its operator, a call that names its first argument, a tag, a brace.
_HEAD = re.compile(
    rf"""(?<![\w$.-])(?P<names>{_NAME}(?:[ \t]*+,[ \t]*+{_NAME}){{1,6}})[ \t]*+=(?!=)"""
    rf"""|(?<![\w$.-])(?P<typed>{_NAME})(?:[ \t]*+:[ \t]*+[\w.\[\]|?*&<>]{{1,60}}|[ \t]++(?P<second>[\w.\[\]*]{{1,60}}))[ \t]*+=(?!=)"""
    rf"""|(?<![\w$.-])(?P<name>{_NAME})["'\]]{{0,2}}[ \t]*+(?P<op>{_OPERATOR})"""
    rf"""|\([ \t]*+["'](?P<argument>{_NAME})["'][ \t]*+,(?=\s*+["'`])"""
    r"""|<(?P<tag>[A-Za-z][\w:.-]*+)(?P<attributes>(?:\s++[\w:.-]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'))*+)\s*+/?>"""
    r"""|(?P<brace>[{}])"""
)
_ATTRIBUTE = re.compile(r"""([\w:.-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""")
_TEXT = re.compile(r"\s*+([^<>\s](?:[^<>]*[^<>\s])?)\s*+</([\w:.-]++)\s*+>")
_GAP = re.compile(r"[ \t]*+(?:\\\n[ \t]*+)?")
_NEXT_LINE = re.compile(r"[ \t]*+(?:#[^\n]*+)?\n[ \t]*+(?=[\"'`(\[])")
_BLOCK = re.compile(r"[ \t]*+[|>][+-]?\d?[ \t]*+\n")
#: Names that only say which name the value beside them has, and what that value is called.
_NAMING, _VALUE = {"name", "key", "id", "variable"}, {"value", "val", "default", "content"}
_IDENTIFIER = re.compile(rf"{_NAME}\Z")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """How sensitive a name's words are; 0 for a harmless one."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if any(w in HARMLESS for w in words):
        return 0.0
    return float(sum(SENSITIVE.get(w) or SENSITIVE.get(w.removesuffix("s"), 0) for w in words))


def literal_score(literal: str) -> float:
    """How much a literal looks like a secret; 0 where it can be none."""
    n = len(literal)
    if n < 6 or literal.lower() in PLACEHOLDERS or literal[0] in "<$%{" or len(set(literal)) < 4:
        return 0.0
    kinds = sum(map(bool, (re.search("[a-z]", literal), re.search("[A-Z]", literal), re.search(r"\d", literal), re.search(r"[^A-Za-z0-9\s]", literal))))
    if any(c.isspace() for c in literal) and kinds < 3:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return (n >= 12) * 0.5 + (kinds - 1) * 0.5 + max(0.0, entropy - 2.0) * 0.5


def decoded(literal: str) -> str:
    """A literal's escapes resolved: of control characters, by number, and of characters that stand for themselves."""
    if "\\" not in literal:
        return html.unescape(literal) if "&" in literal else literal
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else _CONTROL.get(m[4], m[4]), literal)


_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,5})\}|([\s\S]))")
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "v": "\v"}


def _literal(text: str, a: int, b: int) -> tuple[str, int, int]:
    """A quoted span without its quotes."""
    q = 3 if b - a >= 6 and text[a : a + 3] in ('"""', "'''") else 1
    return ('"', a + q, b - q)


def _value(text: str, at: int, several: bool) -> tuple[list[list], list[str], int]:
    """What stands right of an operator: values (lists of joined items), names assigned on the way, and where reading goes on.

    Items are (kind, start, end), kind ``"`` for literals, ``n`` for names.  Commas part values,
    inside brackets or where ``several`` are asked for; elsewhere a comma ends the right side.
    """
    values, names, depth, joined, done = [], [], 0, False, at
    if m := _NEXT_LINE.match(text, at):
        at = m.end()
    while True:
        at = (_SPACE if depth or joined else _GAP).match(text, at).end()
        c = text[at : at + 1]
        if m := _STRING.match(text, at):
            item = _literal(text, *m.span(1))
            if values and (joined or text[done - 1 : done] in "\"'`"):  # joined, or quotes side by side
                values[-1].append(item)
            else:
                values.append([item])
            at = done = m.end()
            joined = False
        elif c and c in "([" and not (values and not joined and not depth):
            at, depth = at + 1, depth + 1
            continue
        elif c and c in ")]" and depth:
            at = done = at + 1
            depth -= 1
            joined = False
        elif (m := _BARE.match(text, at)) and (not values or joined):
            if _CHAIN.match(text, m.end()) and _IDENTIFIER.match(text, *m.span()):
                if depth:
                    break
                names.append(m[0])
                at = done = _CHAIN.match(text, m.end()).end()
                continue
            item = ("n" if _IDENTIFIER.match(text, *m.span()) else '"', *m.span())
            values[-1].append(item) if joined else values.append([item])
            at = done = m.end()
            joined = False
        else:
            break
        after = _SPACE.match(text, at).end()
        if text[after : after + 1] == "+" and text[after + 1 : after + 2] != "=":
            at, joined = after + 1, True
        elif text[after : after + 1] == "," and (depth or several):
            nxt = _SPACE.match(text, after + 1).end() if depth else _GAP.match(text, after + 1).end()
            if not _STRING.match(text, nxt) and not (names or _BARE.match(text, nxt)) or len(values) >= _MOST:
                break
            at, done = nxt, after + 1
            if (m := _STRING.match(text, nxt)) and not _PAIRED.match(text, m.end()):
                values.append([_literal(text, *m.span(1))])
                at = done = m.end()
            elif not depth and (m := _BARE.match(text, nxt)) and not _PAIRED.match(text, m.end()):
                values.append([("n" if _IDENTIFIER.match(text, *m.span()) else '"', *m.span())])
                at = done = m.end()
            else:
                done = after
                break
    return values, names, max(done, 0)


_SPACE = re.compile(r"\s*+")
_CHAIN = re.compile(r"[ \t]*+=(?!=)[ \t]*+")
_PAIRED = re.compile(rf"""["'\]]{{0,2}}[ \t]*+(?:{_OPERATOR})""")
#: Values of one list.
_MOST = 1 << 20


def lex(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]], tuple[int, int, int]]]:
    """(name, items of its right side, (braces, indent, least indent since the last pair)) of every pair, in the order of the text."""
    at, depth, indent, naming, looked = 0, 0, _BLANKS.match(text).end(), None, 0
    while m := _HEAD.search(text, at):
        at = m.end()
        if m["brace"]:
            depth = max(0, depth + (1 if m["brace"] == "{" else -1))
            naming = None
            continue
        least = indent
        for line in _LINE.finditer(text, looked, m.start() + 1):  # lines without a pair end scopes, too
            indent = line.end() - line.start() - 1
            least = min(least, indent)
        looked = m.start()  # what lies before is not looked at again
        level = (depth, indent, least)
        if m["tag"]:
            pairs = [(x[1], (x.start(2), x.end(2)) if x[2] is not None else (x.start(3), x.end(3))) for x in _ATTRIBUTE.finditer(text, m.start("attributes"), m.end("attributes"))]
            for name, (a, b) in pairs:
                yield name, [('"', a, b)], level
            named = {k.lower(): text[a:b] for k, (a, b) in pairs if k.lower() in _NAMING}
            for k, (a, b) in pairs:
                if k.lower() in _VALUE and named:
                    yield from ((n, [('"', a, b)], level) for n in named.values())
            if (x := _TEXT.match(text, at)) and x[2] == m["tag"]:
                yield m["tag"], [('"', *x.span(1))], level
                yield from ((n, [('"', *x.span(1))], level) for n in named.values())
            continue
        names = re.split(r"[ \t]*,[ \t]*", m["names"]) if m["names"] else [m["typed"] or m["argument"] or m["name"]]
        if m["second"]:  # a name and its type, in either order
            names.append(m["second"])
        if (m["op"] or "") == ":" and (x := _BLOCK.match(text, at)):
            items, at = _block(text, x.end(), indent)
            yield names[0], items, level
            continue
        values, more, at = _value(text, at, bool(m["names"]))
        if m["names"] and len(values) > 1:
            yield from ((n, v, level) for n, v in zip(names, values))
        elif values:
            # commas part arguments and items: those of a list are all the name's, what follows a plain value is not
            own = [i for v in (values if _LISTED.match(text, m.end()) else values[:1]) for i in v]
            for n in [*names, *more]:
                yield n, own, level
            if m["name"] and names[0].lower().lstrip("-") in _NAMING and len(own) == 1:
                naming = text[own[0][1] : own[0][2]]
                continue
            if naming and names[0].lower() in _VALUE:
                yield naming, own, level
        naming = None


_BLANKS = re.compile(r"[ \t]*+(?:- [ \t]*+)?")
_LINE = re.compile(r"\n[ \t]*+(?:- [ \t]*+)?(?=\S)")
_LISTED = re.compile(r"\s*+[(\[]")


def _block(text: str, at: int, indent: int) -> tuple[list[tuple[str, int, int]], int]:
    """The lines of a YAML block deeper than ``indent``, without their indents, and where it ends."""
    items = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        begin = _BLANKS_ONLY.match(text, at, end).end()
        if begin < end:
            if begin - at <= indent:
                break
            items.append(('"', begin, end))
        at = end + 1
    return items, min(at, len(text))


_BLANKS_ONLY = re.compile(r"[ \t]*+")


class Scopes:
    """Names by scope: braces and indents around an assignment tell which."""

    def __init__(self):
        self.stack: list[tuple[tuple[int, int], dict]] = [((0, 0), {})]

    def enter(self, depth: int, indent: int, least: int) -> None:
        """Leaves the scopes that a place lies outside of, or that a line before it ended, and begins one if it lies deeper."""
        self._leave((depth, min(least, indent)))
        if self.stack[-1][0] < (depth, indent):
            self.stack.append(((depth, indent), {}))

    def _leave(self, level: tuple[int, int]) -> None:
        while len(self.stack) > 1 and self.stack[-1][0] > level:
            inner = self.stack.pop()[1]
            at, outer = self.stack[-1]
            if len(inner) > len(outer):  # what an inner scope named stays known, behind all that the outer one names
                inner.update(outer)
                self.stack[-1] = (at, inner)
            else:
                for k, v in inner.items():
                    outer.setdefault(k, v)

    def get(self, name: str):
        return next((d[name] for _, d in reversed(self.stack) if name in d), None)

    def set(self, name: str, value) -> None:
        self.stack[-1][1][name] = value


def scan_text(text: str) -> list[tuple[str, int, int, str, float]]:
    """(kind, start, end, name, score) of all findings, by start, kind and end."""
    found = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            found.append(("assign", m.start(), m.end(), m[1], 0.0))
    taken = [f[1:3] for f in found]
    found += [("access", *m.span(), "", 0.0) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), "", 0.0) for m in _HEX.finditer(text)]
    if _HINT.search(text):
        best: dict[tuple[int, int], tuple] = {}
        scopes = Scopes()  # of [literals, the constants joined with them, the score of the most sensitive name that they have reached]
        for name, items, level in lex(text):
            scopes.enter(*level)
            value = [[], [], 0.0]
            for kind, a, b in items:
                known = scopes.get(text[a:b]) if kind == "n" else None
                if known is None:
                    value[0].append((a, b))
                else:
                    value[1].append(known)
            scopes.set(name, value)
            own = name_score(name)
            reached = [(value, "literal")]
            while reached:  # a value is walked again only for a more sensitive name, so joins upon joins take linear time
                v, how = reached.pop()
                if v[2] >= own:
                    continue
                v[2] = own
                for a, b in v[0]:
                    looks = literal_score(decoded(text[a:b]))
                    if looks > 0 and own + looks >= LEAST_SCORE and own + looks > best.get((a, b), (0, 0, 0))[2]:
                        best[a, b] = (how, name, own + looks)
                reached += [(c, "constant") for c in v[1]]
        covered = _inside(sorted(best), taken)
        found += [(k, a, b, name, score) for (a, b), (k, name, score) in best.items() if (a, b) not in covered]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def _inside(spans: list[tuple[int, int]], outer: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Those of ``spans`` that lie in one of ``outer`` (sorted, apart)."""
    out, i = set(), 0
    for a, b in spans:
        while i < len(outer) and outer[i][1] < b:
            i += 1
        if i < len(outer) and outer[i][0] <= a and b <= outer[i][1]:
            out.add((a, b))
    return out


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, findings array<struct<kind, start, end, name, score>>) for every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in kind.value_type]
        for b in batches:
            rows = [[dict(zip(names, f)) for f in scan_text(x or "")] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["key", "findings"])

    src = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("x"))
    out = src.mapInArrow(run, "key long, findings array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>")
    return out.withColumnRenamed("key", key)


def digest(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal, n_constant) of ``scan``'s rows."""
    f = F.col("findings")
    count = lambda k: F.size(F.filter(f, lambda x: x["kind"] == k)).cast("long")
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(f, lambda x: x["kind"].isin(*KINDS[:3]))
    return findings.select(F.col(key).alias("doc_id"), *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(f).alias("spans"), *(count(k).alias(f"n_{k}") for k in KINDS[3:]))
