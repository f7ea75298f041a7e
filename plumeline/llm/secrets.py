"""Secrets in text, by assignment-aware lexing.

A lexer reads source and configuration syntax into tokens: names, operators, brackets, comments and literals, the latter with escapes,
in single, double, back or triple quotes, raw or not. A small parser makes pairs of a name and a literal of them (`name = "literal"`,
`name: literal`, `"name": "literal"`, `name => 'literal'`, `obj["name"] = "literal"`, `--name literal`), joins literals that are
concatenated, and carries constants on, whether they are assigned before or after their use. Each literal is scored by the names that
it reaches and by its own shape. To these spans come those of three fixed patterns. Comments are lexed as text of their own, as
secrets are left in them, too. Documents are scanned where Spark reads them; nothing is shuffled. A text is read once from left to right.

Nulls and empty texts have no spans; repeated rows and null keys give results like others; whole texts are scanned, whatever their length;
an empty table gives an empty table. Further columns stay, unless they have a result's name. Of names that reach one literal the one of the highest score
is reported, and of equal scores the first. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
SPANS = "array<struct<kind: string, start: int, end: int, name: string, score: double>>"

# The base patterns. A run that is too short fails as a whole, so the two run patterns hold their least length.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Tokens. A literal's quotes are not part of its value; bare values of configuration files are read where an operator asks for one.
QUOTED = {q: re.compile(rf"((?:[^\\{q}\n]|\\.)*){q}", re.S) for q in "\"'`"}
TRIPLE = {q: re.compile(rf"((?:[^\\{q}]|\\.|{q}(?!{q}{q}))*){q}{q}{q}", re.S) for q in "\"'"}
TOKEN = re.compile(r"""(?P<name>-{0,2}[A-Za-z_$][\w$]*(?:[.-][\w$]+)*)|(?P<operator>=>|:=|\+=|={1,3}|:(?!/))|(?P<quote>[\"'`])|(?P<other>[+.\[\](){},;\n]|\\\n)|(?P<rest>[^\s])""")
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
ASSIGNS = frozenset(("=", ":", "=>", ":="))
#: Sensitive parts of names, and how much each tells.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "credential": 0.9, "auth": 0.6, "signingkey": 1.0}
#: Least score, and least length of a literal. Placeholders are no secrets.
LEAST_SCORE, LEAST_LENGTH = 1.5, 8
PLACEHOLDER = re.compile(r"^(?:[*xX.]+|<.*>|\$\{.*\}|%\(.*\)|(?i:null|none|true|false|undefined|changeme|example|redacted))$")


def name_weight(name: str) -> float:
    plain = re.sub(r"[^a-z]", "", name.lower())
    return max((w for part, w in SENSITIVE.items() if part in plain), default=0.0)


def shape_weight(literal: str) -> float:
    """From 0 to 1: entropy of the characters, with a share for mixed classes; prose and numbers score low."""
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in Counter(literal).values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 4.5) * (0.4 + 0.2 * min(3, classes)) * (0.5 if " " in literal else 1.0)


#: Letters before a quote that belong to the literal; after others a quote is an apostrophe.
PREFIXES = frozenset("r b f u rb br fr rf".split())
#: Tokens that are kept before and after an assignment or literal; of prose nothing is kept.
BEFORE, AFTER = 6, 16


class Tokens(list):
    """(kind, start, end) of tokens near assignments and literals; a gap stands for all that is left out between."""

    def __init__(self):
        super().__init__()
        self.recent, self.dropped, self.after = [], False, 0

    def add(self, kind: str, start: int, end: int) -> None:
        if kind in ("assign", "literal", "bare"):
            if self.dropped:
                self.append(("gap", start, start))
            self += self.recent
            self.append((kind, start, end))
            self.recent, self.dropped, self.after = [], False, AFTER
        elif self.after:
            self.append((kind, start, end))
            self.after -= 1
        else:
            self.recent.append((kind, start, end))
            if len(self.recent) > BEFORE:
                self.dropped = True
                del self.recent[0]


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Names, options, assigning operators, literals (their values), bare values, and the characters that join or end an assignment."""
    out, at, size, unclosed, word = Tokens(), 0, len(text), set(), ("", -1)
    while m := TOKEN.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "quote":
            quote = m[0]
            if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_") and not (word[1] == m.start() and word[0].lower() in PREFIXES):
                continue
            if quote != "`" and text.startswith(quote * 2, at) and quote not in unclosed:
                found = TRIPLE[quote].match(text, at + 2)
                if found:
                    out.add("literal", *found.span(1))
                    at = found.end()
                    continue
                unclosed.add(quote)  # no later one closes, either
            found = QUOTED[quote].match(text, at)
            if found:
                out.add("literal", *found.span(1))
                at = found.end()
        elif kind == "operator":
            if m[0] in ASSIGNS:
                out.add("assign", *m.span())
                while at < size and text[at] in " \t":
                    at += 1
                bare = BARE.match(text, at)
                if bare and not bare[0].startswith("=") and not (bare[0].lower() in PREFIXES and text[bare.end() : bare.end() + 1] in ("'", '"')):
                    out.add("bare", *bare.span())
                    at = bare.end()
        elif kind == "name":
            word = (m[0], m.end())
            out.add("option" if m[0].startswith("-") else "name", m.end() - len(m[0].lstrip("-")), at)
            if m[0].startswith("--"):
                bare = BARE.match(text, at + 1) if text[at : at + 1] == " " else None
                if bare and not bare[0].startswith("-"):
                    out.add("assign", at, at)
                    out.add("bare", *bare.span())
                    at = bare.end()
        else:
            out.add(m[0], *m.span())
    return out


def value_at(found: list[tuple[str, int, int]], k: int) -> tuple[list[tuple[int, int]], int]:
    """The literals that are joined from the k-th token on, past prefixes, calls and brackets, and the token after them."""
    while k + 1 < len(found) and found[k][0] in ("name", "(", "\\\n") and found[k + 1][0] in ("literal", "(", "name", "\\\n"):
        k += 1
    values = []
    while k < len(found) and found[k][0] == "literal":
        values.append(found[k][1:])
        k += 1
        while k + 1 < len(found) and (found[k][0] in ("+", ".", "\\\n") or found[k][0] == "\n" and found[k + 1][0] in ("+", ".")):
            k += 1
    return values, k


def pairs(text: str) -> list[tuple[str, list[tuple[int, int]], str | None]]:
    """name, spans of the literals that make its value, and the name that stands for the value where it is no literal."""
    found, own = tokens(text), []
    for i, (kind, _, _) in enumerate(found):
        j = i - 1
        while j > 0 and found[j][0] == "]":
            j -= 1
        if kind != "assign" or j < 0 or found[j][0] not in ("name", "option", "literal", "bare"):
            continue
        name = text[found[j][1] : found[j][2]]
        if i + 2 < len(found) and found[i + 1][0] == "bare" and found[i + 2][0] == "assign":
            continue  # what looked like a value is the next pair's name
        if i + 1 < len(found) and found[i + 1][0] == "bare":
            start, end = found[i + 1][1:]
            own.append((name, [(start, end)], text[start:end]))
            continue
        values, k = value_at(found, i + 1)
        if k < len(found) and found[k][0] == "assign":
            values = values[:-1]  # the last literal is the next pair's name
        if values:
            own.append((name, values, None))
    return own


def assigned(text: str) -> list[tuple[int, str, int, str, float]]:
    """Scored literals in the order of their assignment: start, kind, end, the name that made them sensitive, score."""
    own = pairs(text)
    constants: dict[str, list[tuple[int, int]]] = {}
    for name, values, stands in own:
        if stands is None or not re.fullmatch(r"[A-Za-z_$][\w$.]*", stands):
            constants.setdefault(name, values)
    known = dict(constants)  # an assignment below a use counts until there is one above
    found: dict[tuple[int, int], tuple[str, float]] = {}
    for name, values, stands in own:
        if stands is not None and stands != name:
            values = known.get(stands, values)
        known[name] = values
        literal, weight = "".join(text[a:b] for a, b in values), name_weight(name)
        if not weight or len(literal) < LEAST_LENGTH or PLACEHOLDER.match(literal):
            continue
        score = weight + shape_weight(literal)
        for span in values if score >= LEAST_SCORE else ():
            if span[0] < span[1] and score > found.get(span, ("", 0.0))[1]:
                found[span] = (name, score)
    return [(a, "literal", b, name, score) for (a, b), (name, score) in found.items()]


def spans(text: str | None) -> list[tuple]:
    """All spans of a text, by start and then kind."""
    found = []
    if text:
        if "=" in text or ":" in text:
            found += [(m.start(), "assign", m.end(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
            found += assigned(text)
        if "AKIA" in text:
            found += [(m.start(), "access", m.end(), None, 1.0) for m in ACCESS.finditer(text)]
        found += [(m.start(), "hex", m.end(), None, 1.0) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def scan(docs: DataFrame, text: str = "text", result: str = "secrets") -> DataFrame:
    """Adds `result`: the spans of secrets in the whole text, with the name and score behind each."""

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b, "name": n, "score": s} for a, k, b, n, s in spans(t)] for t in texts], dtype=object)

    return docs.drop(result).withColumn(result, find(F.col(text)))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Puts `mark` in the place of each secret (overlapping spans become one); nulls stay null and other texts as they are."""

    @F.pandas_udf("string")
    def put(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, mark) for t in texts], dtype=object)

    return docs.withColumn(text, put(F.col(text)))


def redacted(text: str, mark: str) -> str:
    out, at, end = [], 0, -1
    for a, _, b, *_ in spans(text):
        if a >= end:
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join(out) + text[at:] if out else text
