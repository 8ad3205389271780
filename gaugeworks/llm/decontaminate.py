"""Benchmark decontamination by a generalised suffix automaton over the words of normalised items."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.llm.common import enter, fresh, raw_texts

WINDOW = 10
SHARD_BYTES = 3 << 20  # item text of one automaton (about 120 bytes of memory a byte); more items make more automata, each passed over the documents
#: A-Z to lower case; digits, letters and all bytes of non-ASCII characters are words, the rest are blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


class Automaton:
    """States of all item suffixes. ``advance`` keeps the longest suffix of the stream that some item holds."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        names: list[set[int]] = [set()]
        self.names = [n for n, w in items if w]
        for j, (_, words) in enumerate((n, w) for n, w in items if w):
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)), names)
            walk = 0  # each prefix of the item, and so by links each of its substrings, belongs to it
            for w in words:
                walk = self.next[walk][self.ids[w]]
                names[walk].add(j)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            names[self.link[s]] |= names[s]
        short: dict[int, list[tuple[int, int]]] = {}  # state: (length, item) of whole short items ending in it
        for j, (_, words) in enumerate((n, w) for n, w in items if w):
            if len(words) < window:
                s = 0
                for w in words:
                    s = self.next[s][self.ids[w]]
                short.setdefault(s, []).append((len(words), j))
        self.least = min([min(len(w), window) for _, w in items if w], default=window)
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        self.full: list[tuple[int, ...]] = [()] * len(self.size)  # items with the window that ends here
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.size)  # whole short items that end here
        for s in order:
            up = self.link[s]
            self.ends[s] = tuple(sorted([*self.ends[up], *short.get(s, ())]))
            if self.size[s] >= window:
                self.full[s] = self.full[up] if self.size[up] >= window else tuple(sorted(names[s]))

    def _extend(self, last: int, c: int, names: list[set[int]]) -> int:
        nxt, link, size = self.next, self.link, self.size
        if (q := nxt[last].get(c)) is not None:
            return q if size[q] == size[last] + 1 else self._clone(last, c, q, names)
        new = len(size)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        names.append(set())
        while last != -1 and c not in nxt[last]:
            nxt[last][c] = new
            last = link[last]
        if last != -1:
            q = nxt[last][c]
            link[new] = q if size[q] == size[last] + 1 else self._clone(last, c, q, names)
        return new

    def _clone(self, p: int, c: int, q: int, names: list[set[int]]) -> int:
        new = len(self.size)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        names.append(set())
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans (start, end exclusive) that items' windows cover, merged and in order, and the items."""
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        known = ids >= 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, size, full, ends, window = self.next, self.link, self.size, self.full, self.ends, self.window
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue  # no window fits between words that no item has
            s = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while s and c not in nxt[s]:
                    s = link[s]
                    length = size[s]
                if c in nxt[s]:
                    s, length = nxt[s][c], length + 1
                    most = 0
                    if length >= window:
                        most = window
                        found.update(full[s])
                    for n, j in ends[s]:
                        if n <= length:
                            found.add(j)
                            most = max(most, n)
                    if most:
                        start = i + 1 - most
                        while spans and start <= spans[-1][1]:
                            start = min(start, spans.pop()[0])
                        spans.append((start, i + 1))
        return spans, found


def _shards(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[bool, list[tuple[str, list[bytes]]]]]:
    """Items by hash in shards of bounded text, so that neither the driver nor a broadcast grows with the table; whether it is the last."""
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = total // SHARD_BYTES + 1
    for k in range(n):
        yield k == n - 1, [(r.i, words_of(r.t.encode())) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toLocalIterator()]


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, then: tuple[Callable[[pa.RecordBatch], pa.RecordBatch | None], StructType] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` plus ``_words`` (their number), ``_spans`` array of (start, end) words that an
    item's window covers, and ``_items`` (ids as strings, sorted).

    An item of fewer words than a window is one window; items without words have none. Null or empty texts have no
    words. Repeated documents are judged each; repeated item ids count once; an item without an id hits words but is not
    named. With no items nothing is hit. Where ``docs`` has such columns the three get more underscores.
    ``then`` maps the result further, with its schema, in the same tasks: a second map would need a worker more a core.
    """
    words_, spans_, items_ = fresh(docs.columns, "_words", "_spans", "_items")
    out = docs.withColumns({words_: F.lit(0).cast("long"), spans_: F.lit(None).cast("array<struct<start:int,end:int>>"), items_: F.lit(None).cast("array<string>")})
    sc = docs.sparkSession.sparkContext
    for final, shard in _shards(items, item_id, item_text):
        sent = sc.broadcast(shard)
        place, last = [c for c, _ in out.dtypes].index(text_col), len(out.columns)

        more, schema = then if final and then else (None, out.schema)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=uuid.uuid4().hex, place=place, last=last, more=more) -> Iterator[pa.RecordBatch]:
            auto = _automaton(sent, key, window)
            for b in batches:
                n, spans, names = [], b.column(last - 2).to_pylist(), b.column(last - 1).to_pylist()
                for i in range(b.num_rows):
                    words = words_of(raw_texts(b.column(place).slice(i, 1))[0])
                    new, found = auto.scan(words)
                    n.append(len(words))
                    spans[i] = _merged(spans[i] or (), new)
                    names[i] = sorted({*(names[i] or ()), *(auto.names[j] for j in found)} - {None})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                cols = [*b.columns[: last - 3], pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(names, pa.list_(pa.string()))]
                whole = pa.RecordBatch.from_arrays(cols, names=b.schema.names)
                if more is None:
                    yield whole
                elif (left := more(whole)) is not None:
                    yield left

        out = out.mapInArrow(run, schema)
    return out


def _merged(old, new: list[tuple[int, int]]) -> list[dict]:
    spans: list[list[int]] = []
    for a, b in sorted(chain(((x["start"], x["end"]) for x in old), new)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [{"start": a, "end": b} for a, b in spans]


_LAST: list = [None, None]


def _forget() -> None:
    _LAST[:] = [None, None]


def _automaton(sent, key: str, window: int) -> Automaton:
    """One automaton is held a worker."""
    enter("decontaminate", _forget)
    if _LAST[0] != (key, window):
        _LAST[:] = [(key, window), Automaton(sent.value, window)]
    return _LAST[1]


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document the words hit and the items found. An empty table gives no rows, other columns aren't looked at; odd rows as in ``find``."""
    hits = find(docs.select("doc_id", "text"), items)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return hits.select(
        "doc_id", F.col("_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", most_coverage: float = 0.5) -> DataFrame:
    """Remove hit spans from the text; a document whose words are hit by more than ``most_coverage`` goes.

    Other columns stay as they are, whatever their names; a document without hits keeps its text to the byte, a null one
    stays null. Repeated rows are treated alike; an empty table gives no rows.
    """
    place, at = docs.columns.index(text_col), len(docs.columns)

    def cut_out(b: pa.RecordBatch) -> pa.RecordBatch | None:
        keep, texts = [], []
        for i, (n, spans) in enumerate(zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist(), strict=True)):
            raw = b.column(place)[i].cast(pa.binary()).as_py() if b.column(place)[i].is_valid else None
            if spans:
                if sum(s["end"] - s["start"] for s in spans) > most_coverage * n:
                    continue
                folded = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
                edge = np.flatnonzero(np.diff(np.concatenate([[0], folded, [0]]).astype(np.int8)))
                cuts, from_ = [], 0
                for s in spans:
                    cuts.append(raw[from_ : edge[2 * s["start"]]])
                    from_ = int(edge[2 * s["end"] - 1])
                raw = b"".join([*cuts, raw[from_:]])
            keep.append(i)
            texts.append(raw)
        if not keep:
            return None
        cols = list(b.take(pa.array(keep, pa.int32())).columns[:at])
        cols[place] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(cols, names=b.schema.names[:at])

    return find(docs, items, text_col, then=(cut_out, docs.schema))
