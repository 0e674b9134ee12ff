"""Secret scanning: fixed patterns and assignment-aware lexing.

Besides three patterns of well-known shape, source and configuration syntax is
read as name-literal pairs: ``name = "text"``, ``name: text``, ``"name" => 'text'``.
Pairs define constants; a right-hand side that names a constant, or joins
literals and constants with ``+``, takes their value, so a secret is found where
it stands although the sensitive name appears elsewhere.  A constant is looked
for above its use (the last one of the name) and then below it (the first one).  A literal's score
weighs how sensitive the names are that it reaches and how random it looks.

Kinds: ``assign``, ``access`` and ``hex`` are the patterns; ``literal`` is a
literal given to a sensitive name, ``flow`` one that reaches a sensitive name
through constants.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm import kernels as K
from curatrix.llm import workers
from curatrix.session import ship_package

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "literal", "flow")
_RANK = {k: i for i, k in enumerate(KINDS)}
_KEYS = ("passw", "secret", "token", "apikey", "api_key")

_OPERATOR = re.compile(r":=|=>|[:=]")
# White space between the parts of a pair, with line ends and continuation marks.
_GAP = r"(?:\s|\\\r?\n)*+"
#: A name before an operator, on the reversed text.
_EMAN = re.compile(r"""(?:\s|\n\r?\\)*+["'\]]{0,2}([A-Za-z0-9_.\-]*+)""")
_TERM = re.compile(_GAP + r"""(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|([A-Za-z0-9_$+/.=@%-]))""")
_REST = re.compile(r"[A-Za-z0-9_$+/.=@%-]*+")
_PLUS = re.compile(_GAP + r"\+")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+")
#: What a term on a later line must not be: the name of the next pair.
_PAIR = re.compile(_GAP + r"""(?:"[^"\n]*+"|'[^'\n]*+'|[A-Za-z_][A-Za-z0-9_.\-]*+["'\]]{0,2})[ \t]*+(?::|=(?![=\s]|\Z)|=[ \t]+\S)""")
SENSITIVE = [
    (re.compile(r"pass(?:wd|word|phrase)?(?![a-z])|pwd|private_?key|signing_?key|client_?secret", re.I), 1.0),
    (re.compile(r"secret|api_?key|access_?key|auth_?token|bearer", re.I), 1.0),
    (re.compile(r"token|credential|encryption_?key|auth(?![a-z])", re.I), 0.8),
]
THRESHOLD = 0.5


def name_weight(name: str) -> float:
    """How sensitive a target name is, 0 to 1."""
    name = name.replace("-", "_")
    return max((w for p, w in SENSITIVE if p.search(name)), default=0.0)


def randomness(text: str) -> float:
    """Entropy of a literal's characters against 4 bits, cut at 1; under eight characters or with spaces 0."""
    return _randomness(Counter(text))


def _randomness(counts: Counter) -> float:
    n = counts.total()
    if n < 8 or counts[" "]:
        return 0.0
    return min(1.0, -sum(c / n * math.log2(c / n) for c in counts.values() if c) / 4)


class _Value:
    """What a pair gives its name: spans of literals and values of constants, and how often each character occurs."""

    __slots__ = ("counts", "flows", "parts")

    def __init__(self, parts: list) -> None:
        self.parts = parts
        self.counts: Counter | None = None
        self.flows = False

    def counted(self, text: str) -> Counter:
        """Character counts, values of constants before those that use them; a value that reaches itself adds nothing there."""
        stack, open_ = [self], {id(self)}
        while stack:
            v = stack[-1]
            if v.counts is None:
                wait = [p for p in v.parts if isinstance(p, _Value) and p.counts is None and id(p) not in open_]
                if wait:
                    open_.add(id(wait[-1]))
                    stack.append(wait[-1])
                    continue
                counts = Counter()
                for p in v.parts:
                    if not isinstance(p, _Value):
                        counts.update(text[p[0] : p[1]])
                    elif p.counts is not None:
                        counts.update(p.counts)
                v.counts = counts
            stack.pop()
        return self.counts

    def reached(self) -> Iterator[tuple[int, int]]:
        """Spans of literals that flow into a sensitive name, each value's once."""
        stack = [self]
        while stack:
            v = stack.pop()
            if not v.flows:
                v.flows = True
                stack += [p for p in v.parts if isinstance(p, _Value)]
                yield from (p for p in v.parts if not isinstance(p, _Value))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Pattern matches as (start, end, kind) in code points, leftmost and disjoint within a kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], _RANK[s[2]]))


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals whose score over direct and propagated names reaches the threshold."""
    if "=" not in text and ":" not in text:
        return []
    constants: dict[str, _Value] = {}
    firsts: dict[str, _Value] = {}
    values: list[_Value] = []
    ahead: list[tuple[_Value, int, str]] = []  # words that name no constant so far
    sensitive: list[tuple[float, _Value]] = []
    found: dict[tuple[int, int], str] = {}
    back, n = text[::-1], len(text)
    start, end, run_at, run = 0, 0, 0, None  # the last unquoted stretch, and the characters of its part from run_at
    for op in _OPERATOR.finditer(text):
        name = _EMAN.match(back, n - op.start())[1][::-1].lstrip("0123456789.-")
        if not name:
            continue
        parts: list = []
        words: list[tuple[int, str]] = []
        direct, at = True, op.end()
        before = at
        while term := _TERM.match(text, at):
            k = 1 if term[1] is not None else 2 if term[2] is not None else 3
            a, b = term.span(k)
            if k == 3:
                if not start <= a < end:
                    start, end, run = a, _REST.match(text, b).end(), None
                b = end
            if "\n" in text[before:a] and _PAIR.match(text, at):
                break
            word = _WORD.match(text, a, b) if k == 3 else None
            known = None
            if word and word.end() == b:
                known = constants.get(word[0].rstrip("."))
                if known:
                    direct = False
                else:
                    words.append((len(parts), word[0].rstrip(".")))
            parts.append(known or (a, b))
            before = at = b if k == 3 else b + 1
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        if not parts:
            continue
        value = constants[name] = _Value(parts)
        firsts.setdefault(name, value)
        values.append(value)
        ahead += [(value, k, word) for k, word in words]
        weight = name_weight(name)
        if weight:
            sensitive.append((weight, value))
            if direct and len(parts) == 1 and start <= parts[0][0] < end:
                # Several names may stand in one unquoted stretch: its characters are counted once.
                a = parts[0][0]
                if run is None:
                    run = Counter(text[a:end])
                else:
                    run.subtract(text[run_at:a])
                run_at, counts = a, run
            else:
                counts = value.counted(text)
            if weight * _randomness(counts) >= THRESHOLD:
                if direct:
                    found.update(dict.fromkeys(parts, "literal"))
                else:
                    for span in value.reached():
                        found.setdefault(span, "flow")
    # A word may name a constant that is defined further down.
    late = [(v, k, firsts[w]) for v, k, w in ahead if w in firsts and firsts[w] is not v]
    if late:
        found = {span: kind for span, kind in found.items() if kind == "literal"}
        for v in values:
            v.counts, v.flows = None, False
        for v, k, target in late:
            for span in v.parts:
                found.pop(span, None)
            v.parts[k] = target
        for weight, v in sensitive:
            if any(isinstance(p, _Value) for p in v.parts) and weight * _randomness(v.counted(text)) >= THRESHOLD:
                for span in v.reached():
                    found.setdefault(span, "flow")
    return sorted((a, b, kind) for (a, b), kind in found.items() if b > a)


def spans_of(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of a text, each ordered by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + lexed_spans(text), key=lambda s: (s[0], _RANK[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with the union of ``spans`` replaced by marks, one for each stretch."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _nothing() -> None:
    """Tasks keep no tables."""


def _scan() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            sha, every = [], []
            for _, texts in K.pieces(batch.column(1)):
                for text in texts:
                    base, spans = spans_of(text)
                    for c, k in zip(counts, BASE, strict=True):
                        c.append(sum(s[2] == k for s in base))
                    sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    every.append(joined(spans))
            arrays = [*(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then
    kind, joined by commas.  Null texts count as empty: no spans, an empty string.
    Equal texts have equal spans; repeated rows, and rows without an id, get a
    result each; an empty table gives no rows.  Other columns are ignored,
    whatever their names.  Texts are read whole, whatever their length, a bounded
    number of bytes or one text at a time.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(workers.task("secrets", _scan(), _nothing), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redact(text_at: int, chars_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in K.pieces(batch.column(text_at)):
                part = batch.slice(at, len(texts))
                marked = {r: spans for r, text in enumerate(texts) if (spans := spans_of(text)[1])}
                if marked:
                    columns = list(part.columns)
                    for r, spans in marked.items():
                        texts[r] = redacted(texts[r], spans)
                    columns[text_at] = pa.array(texts, columns[text_at].type)
                    if chars_at >= 0:
                        chars = columns[chars_at].to_pylist()
                        for r in marked:
                            chars[r] = len(texts[r])
                        columns[chars_at] = pa.array(chars, columns[chars_at].type)
                    part = pa.RecordBatch.from_arrays(columns, batch.schema.names)
                yield part

    return run


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[SECRET]``; ``n_chars``, if any, follows.

    All rows and columns stay, repeated rows too; texts without secrets, and null
    and empty ones, are unchanged.  Overlapping spans become one mark.  An empty
    table gives no rows.
    """
    ship_package(docs.sparkSession)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    return docs.mapInArrow(workers.task("secrets", _redact(docs.columns.index("text"), chars), _nothing), docs.schema)
