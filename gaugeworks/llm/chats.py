"""Conversation structure repair: the cheapest edits that give a conversation's roles the form ``(s?(ua)+)?``, by A*.

The lattice has a node for each number of rows read and each state of that form. A* goes on from the node with the least
(cost so far plus heuristic, edits so far); the heuristic is the suffix sum of deletions that must come (3 each) and of
truncated rows (1 each, as keeping costs 1 and deleting more). It is consistent, so nodes are reached in the order of that
key and the first path to a node is its cheapest, ASCII-least one.

A conversation may hold any number of rows. Rows without their texts are dealt by ranges of (conversation, turn), so a
large one is many tasks; in a task, stretches of STRETCH rows are searched from each state they can be entered by and
chained, as are the tasks' pieces afterwards. Then edits meet the texts in order, row by row. Only a conversation's edits,
a byte a row, are held at a time. Its rows are ordered by turn (null first), then role, then a digest of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import cut

WHITE = r"\x20\x09-\x0D"
#: States: nothing yet, after s, after u, after a. What may follow, by a row's initial.
START, S, U, A = range(4)
NEXT = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
TARGET = (("user", U), ("user", U), ("assistant", A), ("user", U))  # the one role that can be inserted or given
TAILS = ("", "II", "I", "")  # insertions that end the form
INITIALS = "sua-"
FINE, TRUNCATED, GONE = range(3)
DELETE, INSERT, REROLE, CHARGE = 3, 2, 2, 1
STRETCH = 48

Ways = dict[int, tuple[int, str]]  # by last state: cost, edits


@lru_cache(1 << 16)
def search(rows: bytes, entry: int, whole: bool) -> Ways:
    """A* over rows (initial * 3 + fault each) from a state. ``whole``: to the best end of the form, after which rows may be
    inserted; else the best way to each state right after the last row."""
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (0, CHARGE, DELETE)[rows[i] % 3]
    open_, closed, found = [(ahead[0], "", 0, entry)], set(), {}

    def reach(cost: int, audit: str, i: int, state: int) -> None:
        if (i, state) not in closed:
            heappush(open_, (cost + ahead[i], audit, i, state))

    while open_:
        total, audit, i, state = heappop(open_)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = total - ahead[i]
        if i == n:
            found[state] = cost, audit
            if whole and state in (START, A):
                return {state: found[state]}
            if not whole:
                continue
        else:
            initial, fault = divmod(rows[i], 3)
            reach(cost + DELETE, audit + "D", i + 1, state)
            if fault != GONE:
                charge = CHARGE * (fault == TRUNCATED)
                if (to := NEXT[state].get(INITIALS[initial])) is not None:
                    reach(cost + charge, audit + "K", i + 1, to)
                reach(cost + REROLE + charge, audit + "R", i + 1, TARGET[state][1])
        reach(cost + INSERT, audit + "I", i, TARGET[state][1])
    return found


def _labels(texts: dict[int, str]) -> dict[int, str]:
    """Short strings that compare like these ones whatever follows them."""
    if len(texts) < 2:
        return dict.fromkeys(texts, "")
    shared = len(commonprefix(list(texts.values())))
    rest = {k: x[shared:] for k, x in texts.items()}
    if not all(rest.values()):  # at one row, what is longer has insertions more, so these are short
        return rest
    out = {}
    for first in {x[0] for x in rest.values()}:
        out |= {k: first + x for k, x in _labels({k: x[1:] for k, x in rest.items() if x[0] == first}).items()}
    return out


def chain(rows: bytes, entry: int) -> Ways:
    """As ``search`` to each state, of any number of rows: stretch by stretch, in time and memory linear in the rows."""
    now, links = {entry: (0, "")}, []  # state: cost, label
    for start in range(0, len(rows), STRETCH):
        best: dict[int, tuple[int, str, int, str]] = {}
        for state, (cost, label) in now.items():
            for to, (more, edits) in search(rows[start : start + STRETCH], state, False).items():
                way = cost + more, label + edits, state, edits
                best[to] = min(best.get(to, way), way)
        links.append({to: (state, edits) for to, (_, _, state, edits) in best.items()})
        labels = _labels({to: text for to, (_, text, _, _) in best.items()})
        now = {to: (best[to][0], labels[to]) for to in best}
    out = {}
    for state, (cost, _) in now.items():
        parts, at = [], state
        for link in reversed(links):
            at, edits = link[at]
            parts.append(edits)
        out[state] = cost, "".join(reversed(parts))
    return out


def finish(ways: Ways) -> tuple[int, str]:
    """The best of these ways with what ends the form."""
    return min((cost + INSERT * len(TAILS[state]), edits + TAILS[state]) for state, (cost, edits) in ways.items())


def follow(pieces: list[dict[int, Ways]]) -> tuple[int, str]:
    """Cost and edits of a conversation from its pieces' ways by first and last state."""
    now: Ways = {START: (0, "")}
    for piece in pieces:
        new: Ways = {}
        for state, (cost, edits) in now.items():
            for to, (more, then) in piece[state].items():
                way = cost + more, edits + then
                new[to] = min(new.get(to, way), way)
        now = new
    return finish(now)


def _mark(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n`` of damaged rows, by a checksum of the conversation and turn; a null is one blank there
    and as role or text. ``n``: how often the row is there."""
    case = F.crc32(F.concat(_mark(F.col("conv_id")), F.lit(":"), _mark(F.col("turn"))).cast("binary")) % 20
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _mark(F.col("role")).alias("role"), _mark(F.col("text")).alias("text"), case.alias("case")).where("case <> 0")
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return out.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("case") == 3, 2).otherwise(1).cast("long").alias("n"))


def _digest() -> list[Column]:
    return [F.xxhash64("text", F.col("role")).alias("h1"), F.xxhash64(F.lit(0x5851F42D), F.col("role"), F.col("text")).alias("h2")]


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, h1, h2, n, blank, cut, again`` of distinct rows, without texts: no character but whitespace; the
    last such character isn't ``.!?``; role and text stand in an earlier turn.

    Equal rows of a turn are summed up before the shuffle. What is earliest is a minimum, so a row that fills a large
    conversation meets the others as one row for each of its turns.
    """
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    cut_off = ~F.col("text").rlike(rf"[.!?][{WHITE}]*+\z")
    light = rows.select("conv_id", "turn", "role", *_digest(), "n", blank.alias("blank"), cut_off.alias("cut"))
    light = light.groupBy("conv_id", "turn", "role", "h1", "h2").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    first = light.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("w"), F.col("h1").alias("x"), F.col("h2").alias("y")).agg(F.min(F.struct("turn")).alias("first"))
    both = light.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("w")) & (F.col("h1") == F.col("x")) & (F.col("h2") == F.col("y")))
    return both.select(*light.columns, (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("again"))


class _Piece:
    """What rows of a conversation that follow each other add up to."""

    def __init__(self) -> None:
        self.codes, self.blank, self.duplicate, self.truncated, self.illegal = bytearray(), 0, 0, 0, 0
        self.turns, self.first, self.last, self.low, self.high = 0, "", "", None, None

    def add(self, turn: int | None, role: str, n: int, blank: bool, cut_off: bool, again: bool) -> None:
        initial = role[:1] if role[:1] and role[:1] in "sua" else "-"
        at = INITIALS.index(initial) * 3
        if blank:
            self.blank += n
            self.codes += bytes([at + GONE]) * n
        else:
            one = GONE if again else TRUNCATED if cut_off else FINE
            self.duplicate += n - (not again)
            self.truncated += one == TRUNCATED
            self.codes += bytes([at + one]) + bytes([at + GONE]) * (n - 1)
        self.illegal += (n - 1) + (self.last != "" and self.last + initial not in ("su", "ua", "au"))
        self.first, self.last = self.first or initial, initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self, conv: object, at: int, inside: bool) -> tuple:
        codes = bytes(self.codes)
        if inside and len(codes) <= 2 * STRETCH:
            ways = [(START, to, *way) for to, way in search(codes, START, True).items()]
        else:
            ways = [(entry, to, *way) for entry in ((START,) if inside else range(4)) for to, way in chain(codes, entry).items()]
        return conv, at, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.turns, self.low, self.high, ways


_PIECE = "conv_id {0}, piece int, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long, ways array<struct<entry:int,to:int,cost:long,edits:string>>"


def pieces(light: DataFrame) -> DataFrame:
    """A row for each conversation and task that holds rows of it, rows being dealt by ranges of their order. The first and the
    last of a task may go on elsewhere, so these keep their best way between any two states."""
    schema = _PIECE.format(dict(light.dtypes)["conv_id"])
    arrow = pa.schema([("conv_id", pa.null()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("turns", "low", "high")), ("ways", pa.list_(pa.struct([("entry", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kind, held, before, size = TaskContext.get().partitionId(), pa.null(), [], None, 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            names = [{"entry": e, "to": t, "cost": c, "edits": x} for w in cols[-1] for e, t, c, x in w]
            offsets = [0]
            for w in cols[-1]:
                offsets.append(offsets[-1] + len(w))
            ways = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, arrow.field("ways").type.value_type))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, f.type) for c, f in zip(cols[1:-1], list(arrow)[1:-1], strict=True)), ways], names=arrow.names)

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for b in batches:
                kind = b.column(0).type
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        first = True
        for conv, group in groupby(rows(), lambda r: r[0]):
            if before is not None:
                held.append(before[1].row(before[0], at, not first))
                first = False
                size += sum(len(w[3]) for w in held[-1][-1]) + 200
                if size > 1 << 20:
                    yield flush()
                    held, size = [], 0
            piece = _Piece()
            for _, *row in group:
                piece.add(*row)
            before = conv, piece
        if before is not None:
            held.append(before[1].row(before[0], at, False))
            yield flush()

    n = int(light.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "h1", "h2")]
    dealt = light.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "role", "n", "blank", "cut", "again").mapInArrow(run, schema)


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_OUT = "conv_id {0}, at long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _merge(found: list[tuple]) -> tuple[int, int, int, int, int, int, str]:
    """Gaps, blank, duplicate, truncated, illegal, cost, audit of a conversation from its pieces in order."""
    blank, duplicate, truncated, illegal = (sum(p[i] for p in found) for i in range(4))
    illegal += sum(a[5] + b[4] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
    known = [p for p in found if p[7] is not None]
    turns = sum(p[6] for p in known) - sum(a[8] == b[7] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1][8] - known[0][7] + 1 - turns if known else 0
    by_entry = [{e: {w["to"]: (w["cost"], w["edits"]) for w in p[9] if w["entry"] == e} for e in {w["entry"] for w in p[9]}} for p in found]
    return gaps, blank, duplicate, truncated, illegal, *follow(by_entry)


def edited(rows: DataFrame) -> DataFrame:
    """Repaired rows ``conv_id, at, role, text`` of damaged ``rows`` (as ``damage`` gives them; ``n`` null: a conversation without
    rows), each conversation's together and in order, behind one row with ``at`` -1, its statistics and ``audit``."""
    held = rows.where("n is not null")
    light = cut(faults(held))
    kind = dict(rows.dtypes)["conv_id"]
    found = pieces(light)
    stats = F.struct(*(F.col(c) for c in found.columns[2:]))
    none = lambda t: F.lit(None).cast(t)
    heads = found.select("conv_id", F.col("piece"), none("long").alias("turn"), none("string").alias("role"), none("long").alias("h1"), none("long").alias("h2"), none("string").alias("text"), none("long").alias("n"), stats.alias("stats"))
    named = rows.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("piece"), *(none(t).alias(c) for c, t in heads.dtypes[2:]))
    texts = held.select("conv_id", none("int").alias("piece"), "turn", "role", *_digest(), "text", "n", none(dict(heads.dtypes)["stats"]).alias("stats"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_last("piece"), *(F.asc_nulls_first(c) for c in ("turn", "role", "h1", "h2"))]
    stream = named.union(heads).union(texts).repartition(parts, "conv_id").sortWithinPartitions(*order).select("conv_id", "piece", "role", "text", "n", "stats")
    names = [x.split(" ")[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, conv_type = 0, pa.null()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = [conv_type, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        def all_rows() -> Iterator[tuple]:
            nonlocal conv_type
            for b in batches:
                conv_type = b.column(0).type
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def repaired(conv: object, group: Iterator[tuple]) -> Iterator[tuple]:
            held, audit, place, at, state = [], None, 0, 0, START
            empty = (None,) * 7

            def inserted(to: int) -> Iterator[tuple]:
                nonlocal place, at, state
                while place < to and audit[place] == "I":
                    role, state = TARGET[state]
                    yield conv, at, role, "", *empty
                    place, at = place + 1, at + 1

            def head() -> tuple:
                nonlocal audit
                *numbers, audit = _merge(held)
                return conv, -1, None, None, *numbers, audit

            for _, piece, role, text, n, stats in group:
                if piece is not None:
                    if piece >= 0:
                        held.append(tuple(stats.values()))
                    continue
                if audit is None:
                    yield head()
                for _ in range(n):
                    yield from inserted(len(audit))
                    edit, place = audit[place], place + 1
                    if edit == "D":
                        continue
                    name, to = TARGET[state] if edit == "R" else (role, NEXT[state].get(role[:1]))
                    state = to
                    yield conv, at, name, text, *empty
                    at += 1
            if audit is None:
                yield head()
            yield from inserted(len(audit))

        for conv, group in groupby(all_rows(), lambda r: r[0]):
            for row in repaired(conv, group):
                out.append(row)
                size += 100 + len(row[3] or "") + len(row[10] or "")
                if size > 4 << 20:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return stream.mapInArrow(run, _OUT.format(kind))


def repair(rows: DataFrame) -> DataFrame:
    """Repaired rows ``conv_id, at, role, text`` of ``conv_id, turn, role, text``; ``at`` counts from 0 in each conversation.

    Null role or text is one blank, a null conv_id a conversation of its own, a null turn comes first. Repeated rows are
    duplicates of the first. A conversation of which nothing is left has no rows; other columns are not looked at.
    """
    whole = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _mark(F.col("role")).alias("role"), _mark(F.col("text")).alias("text"), F.lit(1).cast("long").alias("n"))
    return edited(whole).where("at >= 0").select("conv_id", "at", "role", "text")


def digests(stream: DataFrame) -> DataFrame:
    """A row for each conversation of ``edited``: its statistics, audit, and SHA-256 of the repaired rows, read in order."""
    names = ["conv_id", *STATS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest = None, hashlib.sha256()
        for b in batches:
            kind, done = b.column(0).type, []
            for conv, at, role, text, *numbers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at < 0:
                    if head is not None:
                        done.append((*head, digest.hexdigest()))
                    head, digest = (conv, *numbers), hashlib.sha256()
                else:
                    digest.update(f"{'' if at == 0 else chr(10)}{role}:{text}".encode())
            if done:
                yield _batch(done, kind)
        if head is not None:
            yield _batch([(*head, digest.hexdigest())], kind)

    def _batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * len(STATS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    schema = f"conv_id {dict(stream.dtypes)['conv_id']}, " + ", ".join(f"{c} long" for c in STATS) + ", audit string, repaired_sha256 string"
    return stream.mapInArrow(run, schema)


def report(rows: DataFrame) -> DataFrame:
    """Damage, then repair: a row for each original conversation with its faults, the repair's cost, audit and digest.

    As ``repair``; a conversation without rows after the damage has zeros, an empty audit and the empty string's digest, an
    empty table no rows.
    """
    every = rows.select("conv_id").distinct()
    hurt = damage(rows)
    none = every.select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in hurt.dtypes[1:]))
    return digests(edited(hurt.union(none)))
