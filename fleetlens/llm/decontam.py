"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are cut into windows of consecutive normalised words; the
automaton of all windows scans each document's normalised text once, and hits are
mapped back to words and to offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, kind, pieces, saved, small_batches

#: Letters, digits and everything beyond ASCII are parts of words; A-Z are folded, the rest becomes a space.
FOLDED = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def windows(text: bytes, length: int) -> list[bytes]:
    w = words(text)
    return [b" ".join(w[i : i + length]) for i in range(max(1, len(w) - length + 1))] if w else []


def automaton(patterns: dict[str, tuple[int, list[str]]]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for window, value in patterns.items():
        made.add_word(f" {window} ", value)
    made.make_automaton()
    return made


def _scan(patterns: dict[str, tuple[int, list[str]]], with_spans: bool):
    def scan(batches):
        made = automaton(patterns) if patterns else None
        for b in pieces(batches):
            texts = as_bytes(b.column(1))
            n_words, n_hit, items, spans = [], [], [], []
            for text in texts:
                w = words(text)
                hit, found = _hits(made, f" {b' '.join(w).decode()} ", len(w))
                n_words.append(len(w))
                n_hit.append(int(hit.sum()))
                items.append(sorted(found))
                spans.append(_spans(text.decode(), hit) if with_spans and hit.any() else [])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)], ["doc_id", "n_words", "n_hit", "items", "spans"])

    return scan


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words, as offsets of code points in the original text."""
    out: list[dict] = []
    before = False
    for word, h in zip(WORD.finditer(text), hit.tolist(), strict=True):
        if h and before:
            out[-1]["end"] = word.end()
        elif h:
            out.append({"start": word.start(), "end": word.end()})
        before = h
    return out


def _parts(benchmark: DataFrame, length: int, max_bytes: int) -> Iterator[dict[str, tuple[int, list[str]]]]:
    """The benchmark's windows in parts of at most about ``max_bytes`` of text each, dealt by hash; one part if it is no larger."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // max_bytes))
    for part in range(n):
        patterns: dict[str, tuple[int, set[str]]] = {}
        for item, text in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == part).collect():
            for window in windows((text or "").encode(), length):
                patterns.setdefault(window.decode(), (window.count(b" ") + 1, set()))[1].update([] if item is None else [item])
        yield {w: (n_, sorted(ids)) for w, (n_, ids) in patterns.items()}


def _runs(hit: np.ndarray) -> list[int]:
    """First word and the word after the last of each run of hit words, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()


def _hits(made, joined: str, n: int) -> tuple[np.ndarray, set[str]]:
    """Which of the ``n`` words lie inside an occurrence of a window, and the items with occurring windows."""
    found, marks = set(), []
    for end, (size, ids) in made.iter(joined) if made else ():
        found.update(ids)
        marks.append((end, size))
    hit = np.zeros(n + 1, np.int32)
    if marks:
        gaps = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)
        last = np.searchsorted(gaps, [e for e, _ in marks])  # the words before the gap that ends a match
        np.add.at(hit, last - np.array([s for _, s in marks]), 1)
        np.add.at(hit, last, -1)
    return np.cumsum(hit[:-1]) > 0, found


def _scan_on(patterns: dict[str, tuple[int, list[str]]]):
    """Adds a part's items and hits, as runs of words, to those of the parts before it; the first reads doc_id and text alone."""

    def scan(batches):
        made = automaton(patterns) if patterns else None
        for b in pieces(batches):
            before = zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True) if b.num_columns > 2 else (((), ()) for _ in range(b.num_rows))
            n_words, items, runs = [], [], []
            for text, (known, old) in zip(as_bytes(b.column(1)), before, strict=True):
                w = words(text)
                hit, found = _hits(made, f" {b' '.join(w).decode()} ", len(w))
                for x, y in zip(old[::2], old[1::2], strict=True):
                    hit[x:y] = True
                n_words.append(len(w))
                items.append(sorted({*known, *found}))
                runs.append(_runs(hit))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int32()))], ["doc_id", "text", "n_words", "items", "runs"])

    return scan


def _closed(with_spans: bool):
    """The results of all parts."""

    def close(batches):
        for b in pieces(batches):
            n_hit, spans = [], []
            for text, n, runs in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                hit = np.zeros(n, bool)
                for x, y in zip(runs[::2], runs[1::2], strict=True):
                    hit[x:y] = True
                n_hit.append(int(hit.sum()))
                spans.append(_spans(text.decode(), hit) if with_spans and runs else [])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n_hit, pa.int64()), b.column(3), pa.array(spans, span)], ["doc_id", "n_words", "n_hit", "items", "spans"])

    return close


def find_contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, max_bytes: int = 16 << 20, with_spans: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted distinct ids, as strings) and spans of hit words of every row.

    A window is ``length`` consecutive words of an item, or all words of a shorter one;
    a word is hit inside any occurrence of a window.  Null and wordless texts have no
    words or windows, an item without id marks words but names no item, repeated items
    count once, an empty table or benchmark gives rows without hits.  The benchmark goes
    to every task; above ``max_bytes`` of its text it goes in parts, one scan of the texts
    each, whose hits are put together row by row.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = f"doc_id {kind(docs, 'doc_id')}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
    parts = _parts(benchmark, length, max_bytes)
    patterns = next(parts)
    following = next(parts, None)
    if following is None:
        return docs.select("doc_id", "text").mapInArrow(_scan(patterns, with_spans), schema)
    rest = chain([following], parts)
    rows = docs.select("doc_id", "text").mapInArrow(_scan_on(patterns), f"doc_id {kind(docs, 'doc_id')}, text string, n_words bigint, items array<string>, runs array<int>")
    for patterns in rest:  # a task holds one automaton at a time
        rows = saved(rows).mapInArrow(_scan_on(patterns), rows.schema)
    return rows.mapInArrow(_closed(with_spans), schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10, max_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` without any hit word, with all their columns; one pass for each part of the benchmark, no shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(patterns):
        def run(batches):
            made = automaton(patterns) if patterns else None
            for b in pieces(batches):
                clean = [made is None or next(made.iter(f" {b' '.join(words(t)).decode()} "), None) is None for t in as_bytes(b.column(at))]
                yield b.filter(pa.array(clean, pa.bool_()))

        return run

    out = docs
    for i, patterns in enumerate(_parts(benchmark, length, max_bytes)):
        out = (saved(out) if i else out).mapInArrow(keep(patterns), docs.schema)  # a task holds one automaton at a time
    return out
