"""Secret scans: fixed patterns, and a lexer that follows assignments.

Fixed kinds, each leftmost and non-overlapping over the whole text:

* ``assign``: a sensitive word, ``:`` or ``=``, and a value of at least 8 characters;
* ``access``: ``AKIA`` and capitals or digits, 16 characters or more;
* ``hex``: 32 or more of ``0-9a-f``.

The lexer adds kind ``lexed``.  It reads assignments of source code and configuration
(``name = ``, ``name: ``, ``name := ``, ``"name" => ``, ``export NAME=``, ``obj.name = ``,
``obj["name"] = ``, ``name: type = ``, ``name = name = ``) into pairs of a name and an expression of string
literals, triple-quoted ones too, and names, joined by ``+`` or ``..`` or put in brackets.  Targets inside a
value, such as named arguments and entries, are pairs of their own.  A name that was assigned before stands for
its literals (constants are propagated, in the order of the text), so a literal bound to an innocent name is
found when that name reaches a sensitive target.  Each literal is scored by its target's words and its own
look; literals that score enough are spans, without their quotes.  Arguments of calls and subscripts that are
not named are not read as values.

Spans are code points, end exclusive.  A null or empty text has no spans; very long texts are scanned whole, in linear time.  Every row is scanned alone, so
repeated rows agree; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tamis.llm.batches import slices
from tamis.shared import col

KINDS = ("assign", "access", "hex", "lexed")
MASK = "[redacted]"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("passw", "secret", "token", "api")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[tuple[Span, tuple[int, int]]]:
    """Spans of the fixed kinds, each with the place of its secret value."""
    out: list[tuple[Span, tuple[int, int]]] = []
    folded = text.lower()
    # Lower-casing may change other characters, but it never hides an ASCII word.
    if any(w in folded for w in _WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                out.append(((m.start(), m.end(), "assign"), m.span(2)))
    if "AKIA" in text:
        out += [((*m.span(), "access"), m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [((*m.span(), "hex"), m.span()) for m in _HEX.finditer(text)]
    return out


# Words of a name that make what it is bound to sensitive, and their weight.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "pass": 2, "secret": 3, "secrets": 3, "token": 3, "apikey": 3,
    "credential": 3, "credentials": 3, "private": 1, "access": 1, "auth": 2, "authorization": 2, "bearer": 2, "key": 1,
    "api": 1, "signing": 1, "encryption": 1, "client": 1, "salt": 1, "pin": 1, "dsn": 1, "webhook": 1,
}
# Parts of literals that only hold a secret's place.
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "****", "redacted", "dummy", "sample", "<", "${", "{{", "%(")

# Names start where no name character stands before and give nothing back, so that a search stays linear.
_NAME = r"[A-Za-z_][A-Za-z0-9_]*+"
_DOTTED = rf"(?:{_NAME}[.\-](?=[A-Za-z_]))*+{_NAME}"
_STRING = r"""[brufBRUF]{0,2}"(?:[^"\\\n]|\\.)*+"|[brufBRUF]{0,2}'(?:[^'\\\n]|\\.)*+'"""
_TRIPLE = r"""[brufBRUF]{0,2}\"{3}(?s:[^\\"]|\\.|"(?!""))*+\"{3}|[brufBRUF]{0,2}'{3}(?s:[^\\']|\\.|'(?!''))*+'{3}"""
_TARGET = re.compile(
    rf"""(?:\[\x20*["']({_NAME})["']\x20*\]|["']([A-Za-z_][\w.\- ]{{0,80}})["']|(?<![\w.\-])({_DOTTED})(?:\?(?=\x20*:))?)\x20*+(?::=|=>|=(?!=)|:(?!//))\x20*""",
    re.ASCII,
)
# The type between a declared name's colon and its value.
_TYPE = re.compile(r"""([A-Za-z_&*][\w.:|?!&*<>\[\],'"\x20]{0,80}+)=(?![=>~])\x20*""", re.ASCII)
_TERM = re.compile(rf"(?P<triple>{_TRIPLE})|(?P<string>{_STRING})|(?P<name>{_DOTTED})(?![\w(\[])", re.ASCII)
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*|[ \t]+(?=[\"'])", re.ASCII)
# In brackets: what opens, closes and separates, bare terms, and what follows a term that is a target or a call.
_OPEN = re.compile(r"[(\[{]\s*+")
_CLOSE = re.compile(r"\s*+[)\]}]")
_BETWEEN = re.compile(r"[\s,+]*+")
_BARE_TERM = re.compile(r"[^\s\"'#;,+()\[\]{}=:]++")
_ENDS = re.compile(r"\x20*+(?:=(?!=)|:|[(\[{])")
_RUN = re.compile(r"[^\s\"'#;,]++")
_CALLEE = re.compile(rf"(?:{_DOTTED})?[(\[{{]", re.ASCII)
_BRACKETED = re.compile(rf"[(\[{{]++{_DOTTED}[)\]}}]++;?", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_weight(name: str) -> int:
    """How sensitive the words of a name are."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = ["".join(pair) for pair in zip(parts, parts[1:], strict=False)]
    return sum(SENSITIVE.get(p, 0) for p in dict.fromkeys([*parts, *joined]))


def entropy(value: str) -> float:
    """Bits a character of a value's own distribution."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def literal_score(weight: int, value: str) -> float:
    """Target weight and look of a literal; 4 and more counts as a secret."""
    folded = value.lower()
    if weight < 2 or len(value) < 8 or any(p in folded for p in PLACEHOLDERS):
        return 0.0
    if re.search(r"\s", value) and entropy(value) < 4.2:  # a sentence about secrets
        return 0.0
    mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    return weight + (mixed >= 2) + (entropy(value) >= 3.0) - 2 * (mixed == 1 and entropy(value) < 2.5)


class _Value:
    """Literals of an expression, the values of the names in it, and the greatest weight that reached it."""

    __slots__ = ("literals", "parts", "weight")

    def __init__(self) -> None:
        self.literals: list[tuple[int, int]] = []
        self.parts: list[_Value] = []
        self.weight = 0


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Places of literals that assignments bind to sensitive names."""
    if "=" not in text and ":" not in text:
        return []
    bound: dict[str, _Value] = {}
    found: dict[tuple[int, int], None] = {}
    chain: set[int] = set()  # ends of the targets that share the value at chain_end
    chain_end, value, spot = -1, _Value(), -1
    run_end = 0  # of the last bare run; targets in it are read without running through it again
    target = _TARGET.search(text)
    while target is not None:
        name = target.group(1) or target.group(2) or target.group(3)
        code = _sign(target) == "=" or target.group(3) is None
        end = target.end()
        if end not in chain:
            chain, chain_end = _chain(text, target)
            value = _Value()
            spot = _read(text, chain_end, bound, value)
        whole = bool(value.literals or value.parts)
        at = end
        if whole:
            code |= chain_end > end  # a declared type, or another target
            at = spot if chain_end == end else end
        following = _TARGET.search(text, at)
        if whole and following is not None and chain_end <= following.start() < spot:
            following = _TARGET.search(text, spot)
        mine = value
        if not whole:  # a bare value of a configuration line
            mine = _Value()
            term = _TERM.match(text, end)
            if term is not None and term.lastgroup == "name":
                mine.literals.append(term.span())
            else:
                inner = end < run_end
                if not inner and (run := _RUN.match(text, end)) is not None:
                    run_end = run.end()
                nested = following.start() if following is not None and following.start() < run_end else None
                literal = _bare(text, end, run_end, nested, inner)
                if literal is not None:
                    mine.literals.append(literal)
        if mine.literals or mine.parts or _sign(target) != ":":  # ``if name:`` binds nothing
            bound[name] = bound[re.split(r"[.\-]", name)[-1]] = mine
        weight = name_weight(name)
        if code or weight >= 3:
            reach(mine, weight, text, found)
        target = following
    return list(found)


def _sign(target: re.Match) -> str:
    return target.group().rstrip()[-1]


def _chain(text: str, target: re.Match) -> tuple[set[int], int]:
    """Ends of a target and of those that follow it without a value between, and the place of their value."""
    ends = {target.end()}
    while True:
        at, typed = target.end(), None
        if _sign(target) == ":" and target.group(3) is not None:
            typed = _TYPE.match(text, at)
            if typed is not None and _is_list(typed.group(1)):
                typed = None
        following = _TARGET.match(text, at)
        if following is not None and following.group(3) is not None and (typed is None or following.end() >= typed.end()):
            target = following
            ends.add(target.end())
        elif typed is not None:
            # A simple type, or its last part, reads as a target of its own.
            return ends, typed.end()
        else:
            return ends, at


def _is_list(kind: str) -> bool:
    """Whether a comma or a quote stands outside the brackets of a type: then it is none."""
    depth = 0
    for k, c in enumerate(kind):
        depth += (c in "[<") - (c in "]>")
        if depth <= 0 and (c in ',"' or c == "'" and kind[k - 1] != "&"):
            return True
    return depth != 0


def _read(text: str, at: int, bound: dict[str, _Value], value: _Value) -> int:
    """Collect the literals and known names of the expression at a place; where it ends."""
    depth = 0
    while True:
        if (opened := _OPEN.match(text, at)) is not None:
            depth, at = depth + 1, opened.end()
            continue
        if depth and (closed := _CLOSE.match(text, at)) is not None:
            depth, at = depth - 1, closed.end()
        elif (term := _TERM.match(text, at)) is not None:
            if depth and _ENDS.match(text, term.end()) is not None:  # an entry or a named argument
                return at
            if term.lastgroup != "name":
                quoted = term.group()
                marks = 3 if term.lastgroup == "triple" else 1
                inside = quoted[quoted.index(quoted[-1]) + marks : -marks]
                if marks == 3:
                    inside = inside.strip()
                lo = term.start() + quoted.index(inside, quoted.index(quoted[-1]) + marks)
                value.literals.append((lo, lo + len(inside)))
            elif term.group() in bound:
                value.parts.append(bound[term.group()])
            elif not depth and _JOIN.match(text, term.end()) is None:
                return at
            at = term.end()
        elif depth and (bare := _BARE_TERM.match(text, at)) is not None and _ENDS.match(text, bare.end()) is None:
            at = bare.end()
        else:
            return at
        if depth:
            at = _BETWEEN.match(text, at).end()
        elif (more := _JOIN.match(text, at)) is not None:
            at = more.end()
        else:
            return at


def _bare(text: str, lo: int, run_end: int, nested: int | None, inner: bool) -> tuple[int, int] | None:
    """The literal in a run of bare characters that may hold targets; ``inner`` if the run began before ``lo``."""
    hi = nested if inner and nested is not None else run_end
    if text[run_end : run_end + 1] in ("'", '"') and text[run_end - 1] in "([{=:" and _CALLEE.match(text, lo, hi):
        return None  # the head of a call, a subscript or a list, with a string in it
    if _BRACKETED.fullmatch(text, lo, hi):
        return None  # a name that stands for nothing known
    if inner:
        piece = text[lo:hi].rstrip("&?|([{")
        hi = lo + len(piece if any(c in piece for c in "([{") else piece.rstrip(")]}"))
    return (lo, hi) if hi > lo else None


def reach(value: _Value, weight: int, text: str, found: dict[tuple[int, int], None]) -> None:
    """Score all literals behind a value for a target; a value is walked again only for a greater weight."""
    waiting = [value]
    while waiting:
        now = waiting.pop()
        if now.weight >= weight:
            continue
        now.weight = weight
        for lo, hi in now.literals:
            if literal_score(weight, text[lo:hi]) >= 4:
                found[lo, hi] = None
        waiting += now.parts


def scan(text: str | None) -> tuple[list[Span], list[tuple[int, int]]]:
    """All spans of a text by start, then kind; and the places of the values to mask, merged."""
    if not text:
        return [], []
    base = base_spans(text)
    lexed = lexed_spans(text)
    spans = [s for s, _ in base] + [(lo, hi, "lexed") for lo, hi in lexed]
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    merged: list[list[int]] = []
    for lo, hi in sorted([v for _, v in base] + lexed):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        elif hi > lo:
            merged.append([lo, hi])
    return spans, [(lo, hi) for lo, hi in merged]


def masked(text: str | None) -> str | None:
    """The text with every secret value replaced; names and everything else stay."""
    values = scan(text)[1]
    if not values:
        return text
    out, at = [], 0
    for lo, hi in values:
        out += [text[at:lo], MASK]
        at = hi
    return "".join([*out, text[at:]])


def shown(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{lo}:{hi}" for lo, hi, kind in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: counts of the fixed kinds, their digest, and all spans as text."""
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    key_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [scan(t)[0] for t in part.column("text").to_pylist()]
            base = [[s for s in spans if s[2] != "lexed"] for spans in rows]
            counts = [Counter(s[2] for s in spans) for spans in rows]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    **{f"n_{k}": pa.array([c[k] for c in counts], pa.int64()) for k in KINDS},
                    "base_sha256": pa.array([hashlib.sha256(shown(b).encode()).hexdigest() for b in base], pa.string()),
                    "spans": pa.array([shown(s) for s in rows], pa.string()),
                }
            )

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return source.mapInArrow(run, f"doc_id {key_type}, {counts}, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the secret values of its texts masked; a named length column is kept true.

    All rows and all other columns stay as they are.
    """
    names = docs.columns
    place = names.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            arrays = list(part.columns)
            texts = [masked(t) for t in arrays[place].to_pylist()]
            arrays[place] = pa.array(texts, part.schema.field(place).type)
            if length is not None:
                before = arrays[length].to_pylist()
                after = [len(t) if t is not None and n is not None else n for t, n in zip(texts, before, strict=True)]
                arrays[length] = pa.array(after, part.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
