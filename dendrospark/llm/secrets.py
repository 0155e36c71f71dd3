"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

Base spans come from three patterns, leftmost and without overlaps for each kind.  The lexer adds spans of
kind ``lexed``: it reads name-literal pairs (``name = "x"``, ``name: x``, ``"name" => 'x'``, ``export NAME=x``, XML-like
``name="x"``), splits names at case changes and punctuation, and scores each literal by the
sensitive words among the parts of its names and by how random its characters are.  Constants propagate: with ``K = "x"`` and
``db_password = K`` the literal x is also judged by the second name, through any
chain of names that the text assigns and plain names without digits.  In strings between three quotes, which may have several lines, every
piece between white space is a literal.  The names of ``a: type = b = "x"`` all name x.  A literal counts when its score reaches ``LEAST_SCORE`` and it doesn't overlap a base span.

Spans are code points, end exclusive.

Edge cases: null or empty texts have no spans: counts 0, spans "" and the digest of "".  A null doc_id is kept.  Repeated rows
are scanned one by one.  Extra columns are ignored.  Names that assign themselves or each other in a circle end the chain.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns and the least length of what they match.
KEY = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = re.compile(rf"({KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "lexed")
LEAST_VALUE = 6

# Parts of names that mark what they name as sensitive, with their weight.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3,
    "auth": 1, "key": 1, "private": 1, "access": 1, "api": 1, "signing": 1, "bearer": 2, "salt": 1, "cookie": 1, "session": 1,
}
LEAST_SCORE = 4.0
# The syntax that the lexer reads. Names and values have no greatest length; their repeats are possessive and a name begins
# where its run of characters does, so they stay linear.
HEAD = re.compile(r"""(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)["'\]]{0,2}(?P<space>[\x20\t]*+)(?P<sep>:=|=>|=|:)[\x20\t]*+""")
TYPED = re.compile(r"""(?P<type>[A-Za-z_][A-Za-z0-9_.]*+)(?:\[[^\n:="']*\])?(?:[\x20\t]*\|[\x20\t]*[A-Za-z0-9_.]++)*+[\x20\t]*=[\x20\t]*(?![=>])""")
QUOTED = re.compile(r"""(?P<quote>["'])(?P<text>(?:\\.|(?!(?P=quote))[^\\\n])++)(?P=quote)""")
TRIPLE = re.compile(r"""\"{3}|'{3}""")
BARE = re.compile(r"[A-Za-z0-9_+/.=\-]++")
SOLID = re.compile(r"\S+")
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    joined = "".join(parts)
    return sum(SENSITIVE.get(p, 0) for p in set(parts)) + (3 if "apikey" in joined and "apikey" not in parts else 0)


def literal_score(value: str) -> float:
    """0 to 3: bits a character, and whether letters and digits mix; prose and short words get nothing."""
    if len(value) < 8 or " " in value:
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(t(c) for c in value) for t in (str.islower, str.isupper, str.isdigit))
    return min(2.0, max(0.0, bits - 2.0)) + (1.0 if kinds >= 2 else 0.0)


def _read(text: str) -> tuple[list[tuple[int, int, bool, list[str]]], set[str]]:
    """(start, end, quoted, names) of every value, named by all names of its assignment, and the names that are only types."""
    values, heads, types = [], set(), set()
    at = 0
    while m := HEAD.search(text, at):
        names = []
        while True:
            names.append(m["name"])
            heads.add(m["name"])
            at = m.end()
            if m["sep"] == ":" and (kind := TYPED.match(text, at)):
                names.append(kind["type"])
                types.add(kind["type"])
                at = kind.end()
            following = HEAD.match(text, at)
            # base64 ends in "=" too: without spaces only a quote makes it an assignment
            if not following or following["sep"] == ":" or text.startswith("=", following.end()) or not (following["space"] or text[following.end() : following.end() + 1] in ('"', "'")):
                break
            m = following
        if (q := TRIPLE.match(text, at)) and (stop := text.find(q[0], q.end(), None)) > q.end():
            # each piece between white space of a string over several lines is a literal of its own
            values += [(q.end() + x.start(), q.end() + x.end(), True, names) for x in SOLID.finditer(text[q.end() : stop])]
            at = stop + 3
        elif q := QUOTED.match(text, at):
            values.append((*q.span("text"), True, names))
            at = q.end()
        elif q := BARE.match(text, at):
            if following and following["sep"] == ":":
                continue  # what comes is a pair of its own
            values.append((*q.span(), False, names + q[0].rstrip("=").split("=")[:-1]))
            at = q.end()
    return values, types - heads


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that sensitive names hold, directly or through constants."""
    if "=" not in text and ":" not in text:
        return []
    values, types = _read(text)
    assigned = {n for *_, names in values for n in names}
    literals: list[tuple[int, int, list[str], str]] = []
    gives: dict[str, list[str]] = {}
    for a, b, quoted, names in values:
        value = text[a:b]
        last = value.rsplit("=", 1)[-1]
        if not quoted and (last in assigned or (_PLAIN.match(value) and not any(c.isdigit() for c in value))):
            gives.setdefault(last, []).extend(names)
        else:
            literals.append((a, b, names, value))
    out = []
    for a, b, held, value in literals:
        worth = literal_score(value)
        if not worth:
            continue
        names, todo = set(held), list(held)
        while todo:
            if (name := todo.pop()) in types:
                continue
            for to in gives.get(name, ()):
                if to not in names:
                    names.add(to)
                    todo.append(to)
        top = max(map(name_score, names))
        if top >= 2 and top + worth >= LEAST_SCORE:
            out.append((a, b))
    return out


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, index in KINDS) of all spans, by start, then kind."""
    text = text or ""
    low = text.lower()
    base = []
    if any(h in low for h in HINTS):
        base += [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        base += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    base += [(*m.span(), 2) for m in HEX.finditer(text)]
    more = [(a, b, 3) for a, b in lexed(text) if not any(a < e and s < b for s, e, _ in base)]
    return sorted(base + more, key=lambda x: (x[0], x[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, base, every = [[], [], []], [], []
        for text in batch.column(1):
            found = scan(text.as_py())
            for k in range(3):
                n[k].append(sum(x[2] == k for x in found))
            base.append(hashlib.sha256(joined([x for x in found if x[2] < 3]).encode()).hexdigest())
            every.append(joined(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(base, pa.string()), pa.array(every, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_scans, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows with every span in ``text`` replaced by ``mark``; overlapping spans become one."""

    def clean(text: str | None) -> str | None:
        found = scan(text)
        if not found:
            return text
        out, at = [], 0
        for a, b, _ in found:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array([clean(x.as_py()) for x in batch.column(i)], batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
