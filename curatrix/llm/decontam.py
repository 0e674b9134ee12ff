"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton of all test items is the minimal machine that knows every word
sequence of every item.  A document's words are streamed through it; its state
tells the longest suffix of what was read that occurs in some item.  Where that
length reaches the window the last ``window`` words are hit, and the state on
the suffix-link path that stands for exactly this window names the items.  Items
shorter than a window are hit where they occur whole.

Words are hashed with vector operations first; only runs of benchmark words
long enough to hold a hit are streamed, compared by their bytes.

Test items go to the workers in groups of at most ``automaton_words`` words, so
memory does not follow the benchmark; more items mean more passes, whose spans
are merged for each document.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm import kernels as K
from curatrix.llm import workers
from curatrix.session import materialize, scratch_scope, ship_package

Items = list[tuple[str, list[bytes]]]
SPANS = "array<struct<lo:int,hi:int>>"
FOUND = f"doc_id long, n_words long, n_hit long, items array<string>, spans {SPANS}"


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: Items, window: int) -> None:
        self.window = window
        self.code: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        paths = []
        for name, words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, self.code.setdefault(w, len(self.code)))
                path.append(last)
            paths.append((name, path))
        self._name(items)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _name(self, items: Items) -> None:
        """Which items hold the window of a state, and which short items end in it."""
        n, w = len(self.next), self.window
        up = list(range(n))  # the ancestor whose sequences include the suffix of window length
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in order:
            if self.length[self.link[s]] >= w:
                up[s] = up[self.link[s]]
        self.up = up
        self.items: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            s = 0
            for k, word in enumerate(words):
                s = self.next[s][self.code[word]]
                if k + 1 >= w:
                    self.items.setdefault(up[s], set()).add(name)
            if 0 < len(words) < w:
                short.setdefault(s, []).append((len(words), name))
        self.short: dict[int, list[tuple[int, str]]] = {}
        for s in order:
            got = short.get(s, []) + self.short.get(self.link[s], [])
            if got:
                self.short[s] = got

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans ``[lo, hi)`` over ``words`` and the items found."""
        nxt, link, length, w, code = self.next, self.link, self.length, self.window, self.code
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        state = run = 0
        for i, word in enumerate(words):
            c = code.get(word, -1)
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c not in nxt[state]:
                continue
            state = nxt[state][c]
            run += 1
            lo = i + 1
            if run >= w:
                lo = i + 1 - w
                names |= self.items[self.up[state]]
            for size, name in self.short.get(state, ()):
                if size <= run:
                    lo = min(lo, i + 1 - size)
                    names.add(name)
            if lo <= i:
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append((lo, i + 1))
        return spans, names


def item_words(text: str | None) -> list[bytes]:
    """Words of an item: ASCII letters folded, split at all other ASCII signs."""
    block = next(K.blocks(pa.array([text or ""])))
    w = K.words(block, K.ALNUM)
    data = K.FOLD[block.data].tobytes()
    return [data[a:b] for a, b in zip(w.start, w.end, strict=True)]


_built: dict[bytes, tuple[SuffixAutomaton, np.ndarray, int]] = {}
_MASK = np.uint64((1 << 20) - 1)


def _automaton(items: Items, window: int) -> tuple[SuffixAutomaton, np.ndarray, int]:
    """The automaton, a bitmap of hashes of its words, and the shortest possible hit; kept for later tasks."""
    key = hashlib.blake2b(repr((items, window)).encode(), digest_size=16).digest()
    if key not in _built:
        if len(_built) > 1:
            _built.clear()
        auto = SuffixAutomaton(items, window)
        bitmap = np.zeros(1 << 20, bool)
        if auto.code:
            block = next(K.blocks(pa.array([b" ".join(auto.code)]), 1 << 30))
            bitmap[K.word_hashes(block, K.words(block, K.ALNUM)) & _MASK] = True
        _built[key] = (auto, bitmap, min((min(len(w), window) for _, w in items if w), default=1))
    return _built[key]


def _runs(inside: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true values of at least ``least``, none across ``bounds``."""
    n = len(inside)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate(([False], inside[:-1]))
    before[bounds[bounds < n]] = False
    after = np.concatenate((inside[1:], [False]))
    after[bounds[(bounds > 0)] - 1] = False
    lo, hi = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = hi - lo >= least
    return lo[long], hi[long]


def _search(items: Items, window: int) -> Callable:
    """Map texts to FOUND; spans are byte ranges of the text's UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, bitmap, least = _automaton(items, window)
        for batch in batches:
            n_words, n_hit, names, spans = [], [], [], []
            for block in K.blocks(batch.column(1)):
                w = K.words(block, K.ALNUM)
                rows = len(block.bounds) - 1
                n_words += np.diff(w.bounds).tolist()
                hits, found = [0] * rows, [[] for _ in range(rows)]
                named: list[set[str]] = [set() for _ in range(rows)]
                inside = bitmap[K.word_hashes(block, w) & _MASK]
                for lo, hi in zip(*_runs(inside, w.bounds, least), strict=True):
                    row = int(np.searchsorted(w.bounds, lo, "right")) - 1
                    text = K.FOLD[block.data[w.start[lo] : w.end[hi - 1]]].tobytes()
                    base = w.start[lo]
                    got, which = auto.scan([text[a:b] for a, b in zip(w.start[lo:hi] - base, w.end[lo:hi] - base, strict=True)])
                    named[row] |= which
                    for x, y in got:
                        hits[row] += y - x
                        found[row].append((int(w.start[lo + x] - block.bounds[row]), int(w.end[lo + y - 1] - block.bounds[row])))
                n_hit += hits
                names += [sorted(x) for x in named]
                spans += [[{"lo": a, "hi": b} for a, b in x] for x in found]
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, *batch.columns[2:]], ["doc_id", "n_words", "n_hit", "items", "spans", *batch.schema.names[2:]])

    return run


def _release() -> None:
    _built.clear()
    K.release()


def _task(run: Callable) -> Callable:
    return workers.task("decontamination", run, _release)


def item_groups(benchmark: DataFrame, automaton_words: int) -> Iterator[Items]:
    """Items as (id, words) in groups of at most ``automaton_words`` words or one item; null ids read as ''.

    Items come one partition at a time and groups are made as they are asked for.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    group: Items = []
    held = 0
    for r in rows.toLocalIterator():
        words = item_words(r.text)
        if held and held + len(words) > automaton_words:
            yield group
            group, held = [], 0
        group.append((r.item_id, words))
        held += len(words)
    yield group


def _groups(benchmark: DataFrame, automaton_words: int) -> tuple[Items, Iterator[Items] | None]:
    """The only group, or none and all groups."""
    groups = item_groups(benchmark, automaton_words)
    first, second = next(groups), next(groups, None)
    return ([], itertools.chain((first, second), groups)) if second is not None else (first, None)


def _hits(texts: DataFrame, groups: Iterator[Items], window: int) -> DataFrame:
    """``_hash, _items, _spans`` of the texts of ``texts(_hash, text)`` that any group hits, spans not merged.

    One pass for each group, whose hits are written before the next group is
    fetched: the driver and the workers hold one group at a time.
    """
    found = None
    for group in groups:
        here = texts.mapInArrow(_task(_matching(group, window)), f"_hash binary, _items array<string>, _spans {SPANS}")
        here = materialize(here, "hits")
        found = here if found is None else found.unionByName(here)
    one = found.groupBy("_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_items"), F.array_distinct(F.flatten(F.collect_set("_spans"))).alias("_spans"))
    return materialize(one, "hits")


def _matching(items: Items, window: int) -> Callable:
    """Map (_hash, text) to the hits of a group, each text's once in a task."""
    search = _search(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probe = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(1)], ["doc_id", "text"])
            (found,) = search(iter([probe]))
            at = pa.array(np.flatnonzero(found.column(2).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), found.column(3).take(at), found.column(4).take(at)], ["_hash", "_items", "_spans"])

    return run


def _text_hash(text: F.Column) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, automaton_words: int = 200_000) -> DataFrame:
    """``doc_id, n_words, n_hit, items array<string>, spans array<struct<lo, hi>>`` for each row of ``docs``.

    ``n_hit`` counts words inside an occurrence of ``window`` consecutive item
    words, or of a whole item of fewer; ``items`` are the sorted ids of items
    with such occurrences; ``spans`` are disjoint byte ranges of the text's
    UTF-8 form.  Null and empty texts have no words; items without words match
    nothing; an empty benchmark hits nothing; an empty ``docs`` gives no rows.
    Equal texts have equal results; repeated rows get one each; other columns are
    ignored, whatever their names.  Texts are searched whole.

    A benchmark of more than ``automaton_words`` is searched in passes; their
    hits, by a digest of the text, are merged and joined back.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    only, groups = _groups(benchmark, automaton_words)
    if groups is None:
        return rows.mapInArrow(_task(_search(only, window)), FOUND)
    with scratch_scope(docs.sparkSession) as result:
        hits = result(_hits(rows.select(_text_hash(F.col("text")).alias("_hash"), "text"), groups, window), "hit-texts")
    keyed = rows.withColumn("_hash", _text_hash(F.col("text")))
    return keyed.join(hits, "_hash", "left").select("doc_id", "text", "_items", "_spans").mapInArrow(_task(_recount), FOUND)


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the text, and those inside merged spans."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    for batch in batches:
        for at, texts in K.pieces(batch.column(1)):
            part = batch.slice(at, len(texts))
            n_words, n_hit, merged = [], [], []
            for text, spans in zip(texts, part.column(3).to_pylist(), strict=True):
                whole, n, hit = merge_spans(text or "", spans or [])
                n_words.append(n)
                n_hit.append(hit)
                merged.append(whole)
            items = [x or [] for x in part.column(2).to_pylist()]
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(merged, kind)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "n_words", "n_hit", "items", "spans"])


def cut_spans(text: str, spans: list[dict], mark: str = " ") -> str:
    """``text`` without the byte ranges ``spans``, each replaced by ``mark``."""
    raw, out, at = text.encode(), [], 0
    for s in spans:
        out.append(raw[at : s["lo"]])
        at = s["hi"]
    out.append(raw[at:])
    return mark.encode().join(out).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_share: float = 0.5, automaton_words: int = 200_000) -> DataFrame:
    """``docs`` with hit spans removed from ``text``; documents over ``max_share`` of hit words go.

    A text without hits stays as it is, to the letter; a share equal to
    ``max_share`` stays.  ``n_chars``, if there is one, follows the new text.
    Null texts stay null, empty ones empty.  All columns stay; repeated rows are
    treated alike; an empty table, or benchmark, changes nothing.

    A benchmark of more than ``automaton_words`` is searched in passes over the
    untouched text; their spans are merged, cut once and the share is tested once,
    so the bound does not change the result.
    """
    ship_package(docs.sparkSession)
    only, groups = _groups(benchmark, automaton_words)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = (docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1)
    if groups is None:
        return docs.mapInArrow(_task(_clean(only, window, max_share, *at)), schema)
    names = [f"_c{k}" for k in range(len(docs.columns))]  # the caller's names may clash with ours
    plain = docs.toDF(*names)
    text = F.col(names[at[0]])
    with scratch_scope(docs.sparkSession) as result:
        hits = result(_hits(plain.select(_text_hash(text).alias("_hash"), text.cast("string").alias("text")), groups, window).drop("_items"), "hit-texts")
    joined = plain.withColumn("_hash", _text_hash(text)).join(hits, "_hash", "left").select(*names, "_spans")
    return joined.mapInArrow(_task(_cut_gathered(max_share, *at)), schema)


def merge_spans(text: str, spans: list[dict]) -> tuple[list[dict], int, int]:
    """Byte ranges over whole words merged where their words overlap or adjoin; the words of the text, and those inside."""
    block = next(K.blocks(pa.array([text]), 1 << 31))
    w = K.words(block, K.ALNUM)
    if not spans:
        return [], len(w.start), 0
    lo = np.searchsorted(w.start, [s["lo"] for s in spans])
    hi = np.searchsorted(w.end, [s["hi"] for s in spans]) + 1
    merged: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [{"lo": int(w.start[a]), "hi": int(w.end[b - 1])} for a, b in merged], len(w.start), sum(b - a for a, b in merged)


def _cut_gathered(max_share: float, text_at: int, chars_at: int) -> Callable:
    """Cut the spans of the last column, which goes; rows over ``max_share`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, spans = list(batch.columns[:-1]), batch.column(batch.num_columns - 1)
            rows = np.flatnonzero(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
            keep, names = np.ones(batch.num_rows, bool), batch.schema.names[:-1]
            if len(rows):
                texts = columns[text_at].to_pylist()
                chars = columns[chars_at].to_pylist() if chars_at >= 0 else None
                for r in rows.tolist():
                    merged, n, hit = merge_spans(texts[r], spans[r].as_py())
                    keep[r] = hit <= max_share * n
                    texts[r] = cut_spans(texts[r], merged)
                    if chars is not None:
                        chars[r] = len(texts[r])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if chars is not None:
                    columns[chars_at] = pa.array(chars, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return run


def _clean(items: Items, window: int, max_share: float, text_at: int, chars_at: int) -> Callable:
    search = _search(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_at)
            probe = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), column], ["doc_id", "text"])
            (found,) = search(iter([probe]))
            hit, n = found.column(2).to_numpy(), found.column(1).to_numpy()
            rows = np.flatnonzero(hit)
            if not len(rows):
                yield batch
                continue
            texts, spans = column.to_pylist(), found.column(4)
            for r in rows.tolist():
                texts[r] = cut_spans(texts[r], spans[r].as_py())
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, column.type)
            if chars_at >= 0:
                chars = columns[chars_at].to_pylist()
                for r in rows.tolist():
                    chars[r] = len(texts[r])
                columns[chars_at] = pa.array(chars, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(hit <= max_share * n))

    return run
