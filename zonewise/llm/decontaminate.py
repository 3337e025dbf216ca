"""Benchmark decontamination by a generalised suffix automaton.

The test items' normalised words make one automaton over all their subsequences
of adjacent words. Each document's words stream through it; the automaton keeps
the longest suffix read so far that occurs in an item. Wherever that length
reaches ``WINDOW`` words, or a whole item that is shorter, the words are hit.

The automaton is sent to the workers, as sorted arrays of about 70 bytes a word.
Its size follows the benchmark, not the documents, and is checked: items are packed into automata of at most
``max_words`` words each, and the documents stream through one after the other
in a chain of map steps, so each worker holds one of bounded size and no item is
left out.

A document is contaminated if a hit exists and hits make up at least 1/20 of its
words. ``remove_spans`` cuts the hit spans out of such documents and leaves all
others as they are.

Defined cases: a null or word-less text has no words and no hits; null or
word-less items make no window; items with equal ids count once; a null id is named
by the empty string; repeated
documents each come back; empty tables give empty results or no hits; further
columns are not read.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches

WINDOW = 13
#: A document is contaminated if COVERAGE * hit words >= its words.
COVERAGE = 20
MAX_WORDS = 2_000_000
#: A-Z to a-z; digits, a-z and bytes of other characters stay; the rest separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(body: bytes | None) -> list[bytes]:
    return (body or b"").translate(FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the empty one."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next, self.link, self.len = [{}], [-1], [0]
        seqs = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        self.shortest = min([window, *(len(s) for _, s in seqs)])
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self._pack()
        n = len(self.len)
        #: The state of a reading's last ``window`` words, by state; -1 below that length.
        self.full = array("i", [-1]) * n
        of: dict[int, set[int]] = {}
        own: dict[int, dict[int, set[str]]] = {}
        self.names = sorted({item for item, _ in seqs})
        number = {name: i for i, name in enumerate(self.names)}
        order = sorted(range(n), key=self.len.__getitem__)
        for s in order[1:]:
            up = self.link[s]
            if self.len[s] >= window:
                self.full[s] = s if self.len[up] < window else self.full[up]
        for item, seq in seqs:
            s = length = 0
            for c in seq:
                s, length = self.step(s, length, c)
                if length >= window:
                    of.setdefault(self.full[s], set()).add(number[item])
            if len(seq) < window:
                own.setdefault(s, {}).setdefault(len(seq), set()).add(item)
        #: Items of the windows that end in a state: numbers in ``of_item``, from ``of_first`` of the state to that of the next.
        self.of_first, self.of_item = array("i", [0]), array("i")
        for s in range(n):
            self.of_item.extend(sorted(of.pop(s, ())))
            self.of_first.append(len(self.of_item))
        #: Whole items below the window that end in a state, longest first; states without any are left out.
        self.short: dict[int, tuple] = {}
        for s in order[1:]:
            shorter = self.short.get(self.link[s], ())
            if s in own:
                shorter = (*((k, frozenset(v)) for k, v in sorted(own[s].items(), reverse=True)), *shorter)
            if shorter:
                self.short[s] = shorter

    def _pack(self) -> None:
        """Edges as sorted arrays: words in ``word``, states in ``to``, those of a state from ``first`` of it to that of the next."""
        self.first, self.word, self.to = array("i", [0]), array("i"), array("i")
        for s, edges in enumerate(self.next):
            for c in sorted(edges):
                self.word.append(c)
                self.to.append(edges[c])
            self.first.append(len(self.word))
            self.next[s] = None  # a state's dictionary goes as soon as it is packed
        del self.next
        self.link, self.len = array("i", self.link), array("i", self.len)

    def nbytes(self) -> int:
        """Bytes of the arrays; the words themselves come on top."""
        return sum(len(x) * x.itemsize for x in (self.first, self.word, self.to, self.link, self.len, self.full, self.of_first, self.of_item))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.len[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def step(self, s: int, length: int, c: int) -> tuple[int, int]:
        word, first = self.word, self.first
        while True:
            end = first[s + 1]
            at = bisect_left(word, c, first[s], end)
            if at < end and word[at] == c:
                return self.to[at], length + 1
            if s == 0:
                return 0, 0
            s = self.link[s]
            length = self.len[s]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit word spans (start, end), items with occurring windows, the longest matching length."""
        if not self.ids or len(words) < self.shortest:
            return [], set(), 0
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        # a word of no item ends every match: only runs of known words that can hold a window are read
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        spans, items, longest = [], set(), 0
        ended: set[int] = set()
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j - i < self.shortest:
                continue
            s = length = 0
            for at, c in enumerate(ids[i:j].tolist(), i + 1):
                s, length = self.step(s, length, c)
                if length < self.shortest:
                    continue
                longest = max(longest, length)
                size = 0
                if length >= self.window:
                    size = self.window
                    ended.add(self.full[s])
                for k, found in self.short.get(s, ()):
                    if k <= length:
                        items |= found
                        size = max(size, k)
                if size:
                    while spans and spans[-1][0] >= at - size:
                        spans.pop()
                    if spans and spans[-1][1] >= at - size:
                        spans[-1] = (spans[-1][0], at)
                    else:
                        spans.append((at - size, at))
        for s in ended:
            items.update(self.names[i] for i in self.of_item[self.of_first[s] : self.of_first[s + 1]])
        return spans, items, longest


def automata(benchmark: DataFrame, max_words: int = MAX_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[Automaton]:
    """Automata over all items, each of at most max_words words (or one item). Items arrive partition by partition."""
    rows = as_bytes(benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")), "item")
    held, size = [], 0
    for row in rows.toLocalIterator():
        words = words_of(row["body"])
        if held and size + len(words) > max_words:
            yield Automaton(held)
            held, size = [], 0
        held.append(("" if row["item"] is None else row["item"], words))
        size += len(words)
    yield Automaton(held)


def scan(docs: DataFrame, benchmark: DataFrame, *keep: str, text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """The columns ``keep`` of every document with n_words, longest (matching length), spans (flat
    word offsets: start, end, start, end, ...) and items (sorted ids with occurring windows)."""
    spark = docs.sparkSession
    rows = as_bytes(docs.select(*keep, F.col(text_col).alias("text")), *keep)
    rows = rows.select(*keep, "body", F.lit(0).cast("long").alias("n_words"), F.lit(0).alias("longest"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for automaton in automata(benchmark, max_words):
        sent = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scan_words = sent.value.scan
            for batch in batches:
                cols = {n: batch.column(n) for n in batch.schema.names}
                n_words, longest, spans, items = [], [], [], []
                for body, most, had, of in zip(cols["body"], cols["longest"].to_pylist(), cols["spans"].to_pylist(), cols["items"].to_pylist(), strict=True):
                    words = words_of(body.as_py())
                    more, found, length = scan_words(words)
                    merged: list[int] = []
                    for i, j in sorted([*zip(had[::2], had[1::2], strict=True), *more]):
                        if merged and merged[-1] >= i:
                            merged[-1] = max(merged[-1], j)
                        else:
                            merged += (i, j)
                    n_words.append(len(words))
                    longest.append(max(most, length))
                    spans.append(merged)
                    items.append(sorted(found.union(of)))
                cols |= {"n_words": pa.array(n_words, pa.int64()), "longest": pa.array(longest, pa.int32()), "spans": pa.array(spans, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

        rows = map_batches(rows, run, rows.schema)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    found = scan(docs, benchmark, id_col, text_col=text_col)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: x.cast("long") - acc)  # alternating sum: ends less starts
    return found.select(
        F.col(id_col).alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "longest",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words")))


def cut(body: bytes, spans: list[int]) -> bytes:
    """body without the words of these spans, nor what stands between them; one blank takes their place."""
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", body.translate(FOLD))]
    out, done = [], 0
    for i, j in zip(spans[::2], spans[1::2], strict=True):
        out.append(body[done : at[i][0]].rstrip())
        done = at[j - 1][1]
    out.append(body[done:].lstrip())
    return b" ".join(x for x in out if x)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the hit spans cut from contaminated texts; cutting is repeated until the text is clean.

    Every other column and row comes back as it is, but n_chars, where there is
    one, follows the text. A text of hits alone becomes empty and its row is dropped.
    """
    sent = [docs.sparkSession.sparkContext.broadcast(a) for a in automata(benchmark)]

    def clean(body: bytes | None) -> bytes | None:
        while body:
            words = words_of(body)
            spans: list[tuple[int, int]] = []
            for b in sent:
                spans += b.value.scan(words)[0]
            flat: list[int] = []
            for i, j in sorted(spans):
                if flat and flat[-1] >= i:
                    flat[-1] = max(flat[-1], j)
                else:
                    flat += (i, j)
            hit = sum(flat[1::2]) - sum(flat[::2])
            if not hit or COVERAGE * hit < len(words):
                break
            body = cut(body, flat)
        return body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            before = [x.as_py() for x in batch.column(i)]
            texts = [None if x is None else clean(x.encode()).decode() for x in before]
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols[text_col] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in zip(cols["n_chars"].to_pylist(), before, texts, strict=True)], cols["n_chars"].type)
            stay = pa.array([a == b or bool(b) for a, b in zip(before, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols)).filter(stay)

    return map_batches(docs, run, docs.schema)
