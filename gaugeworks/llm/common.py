"""What the operators share: text access, row identities, cuts of lineage, stars of bands, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch of at most ``most`` bytes of text, one row at least, so memory doesn't follow the batch size."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder that spark.checkpoint.dir names; where it is unset, a local one in local mode, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gaugeworks-"))


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``taken``, upper or lower case."""
    low = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def row_id(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """128 bits that name a row by its doc_id and text; equal rows are one document."""
    i = F.col(doc_id).cast("string")
    return F.xxhash64(i, F.col(text)), F.xxhash64(F.lit(0x5851F42D), F.col(text), i)


def order_of(docs: DataFrame) -> Column:
    """Documents' order as a long: an integer doc_id itself, another kind of id by its hash, null first."""
    kind = dict(docs.dtypes)["doc_id"]
    at = F.col("doc_id").cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64("doc_id")
    return F.coalesce(F.when(F.col("doc_id").isNotNull(), at), F.lit(-(2**63)))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table of the shared folder."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of phases whose results have been cut."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_HELD: dict[str, Callable[[], None]] = {}


def enter(owner: str, forget: Callable[[], None]) -> None:
    """At the start of a task that keeps tables in its Python worker: those of other operators go, as workers outlive stages."""
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    _HELD[owner] = forget


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ x >> np.uint64(31)


def _stars(key: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges (key, member, centre) of each key's star, and (key, centre) in the order of keys. Keys are hashes, so the centre varies from key to key."""
    order = np.argsort(key)
    key, ident = key[order], ident[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.diff(np.append(first, len(key)))
    keys, centres = key[first], ident[first]
    several = np.flatnonzero(many > 1)
    part = np.repeat(many > 1, many)
    key, ident, many = key[part], ident[part], many[several]
    if len(key):
        first = np.cumsum(many) - many
        draw = (ident ^ key).view(np.uint64)
        won = np.flatnonzero(draw == np.repeat(np.minimum.reduceat(draw, first), many))
        centres[several] = ident[won[np.searchsorted(won, first)]]
    centre = np.repeat(centres[several], many)
    other = ident != centre
    return key[other], ident[other], centre[other], keys, centres


#: Rows of blocks: a deal's 64-bit integers of one kind, row by row. JVM work follows the number of blocks.
BLOCKS = "deal int, kind byte, data binary"
EDGES, CENTRES, PLACES, GONE = range(4)
WIDTH = (3, 2, 6, 3)
_FLUSH = 1_500_000


def deals(spark: SparkSession) -> int:
    """Deals of an exchange of blocks: several for each partition, so that a task holds a part of its own at a time."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(kind: int, by: np.ndarray, cols: list[np.ndarray], n: int) -> pa.RecordBatch:
    """``cols`` dealt by the hashes ``by``, one row for each deal; nothing is moved if these are in order."""
    deal = ((by >> 40) + (1 << 23)) * n >> 24
    table = np.stack(cols, 1)
    if (deal[1:] < deal[:-1]).any():
        order = np.argsort(deal, kind="stable")
        table, deal = table[order], deal[order]
    first = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1]]))
    ends = np.append(first, len(deal)) * 8 * len(cols)
    data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(table))])
    return pa.RecordBatch.from_arrays([pa.array(deal[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int8)), data], names=["deal", "kind", "data"])


def star_blocks(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[pa.RecordBatch]:
    """Local stars of (key, id) pairs: an edge for each member, and only the centre goes on to meet other tasks'."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, a, b, keys, centres = _stars(np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held]))
        if len(key):
            yield blocks(EDGES, a ^ key, [key, a, b], n)  # edges go anywhere
        yield blocks(CENTRES, keys, [keys, centres], n)

    for key, ident in pairs:
        held.append((key, ident))
        size += len(key)
        if size > _FLUSH:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def _by_deal(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]]]:
    """Tables of each kind of one deal at a time; rows come sorted by deal."""
    now, held = None, [[] for _ in WIDTH]
    for b in batches:
        for deal, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if deal != now:
                if now is not None:
                    yield held
                now, held = deal, [[] for _ in WIDTH]
            held[kind].append(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, WIDTH[kind]))
    if now is not None:
        yield held


def later_places(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of (k, h, ord, r, q, at) rows without repeated ones, and which of these are first of their (k, h)."""
    order = np.lexsort(cols[::-1])
    k, h, o, r, q, at = (c[order] for c in cols)
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
    again = np.concatenate([[False], ~new[1:] & (o[1:] == o[:-1]) & (r[1:] == r[:-1]) & (q[1:] == q[:-1]) & (at[1:] == at[:-1])])
    return order[~again], new[~again]


def meet(local: DataFrame) -> DataFrame:
    """``kind, x, y, z``: edges (key, a, b) of all stars, and places (r, q, at) that aren't first of their (k, h).

    A key has at most one entry for each map task and flush here, however many ids hold it.
    """
    names = ["kind", "x", "y", "z"]

    def rows(kind: int, cols: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int8)), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_deal(batches):
            for kind in (EDGES, GONE):
                for t in held[kind]:
                    yield rows(kind, list(t.T))
            if held[CENTRES]:
                t = np.concatenate(held[CENTRES])
                key, a, b, _, _ = _stars(np.ascontiguousarray(t[:, 0]), np.ascontiguousarray(t[:, 1]))
                if len(key):
                    yield rows(EDGES, [key, a, b])
            if held[PLACES]:
                t = np.concatenate(held[PLACES])
                order, first = later_places(list(t.T))
                if not first.all():
                    yield rows(GONE, list(t[order[~first]][:, 3:].T))

    n = int(local.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return local.repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(run, "kind byte, x long, y long, z long")


def edges_of(met: DataFrame) -> DataFrame:
    return met.where(F.col("kind") == EDGES).select(F.col("x").alias("key"), F.col("y").alias("a"), F.col("z").alias("b"))


def regroup(rows: DataFrame) -> DataFrame:
    """Stars anew among (key, id) rows, say of members that failed against their centre."""
    n = deals(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from star_blocks(((x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows), n)

    return edges_of(meet(rows.select("key", "id").mapInArrow(run, BLOCKS)))


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``node, root`` of the components ``roots`` once the edges ``a, b`` of ``more`` are added to theirs."""
    at = roots.withColumnRenamed("node", "a").withColumnRenamed("root", "ra")
    with_a = more.join(at, "a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
    bt = roots.withColumnRenamed("node", "b").withColumnRenamed("root", "rb")
    between = cut(with_a.join(bt, "b", "left").select("a", F.coalesce("rb", "b").alias("b")).distinct())
    if between.isEmpty():
        return roots
    higher = components(between)  # of roots, and of nodes without an edge so far
    out = roots.join(higher.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return cut(out.union(higher.join(roots.select("node"), "node", "left_anti").select("node", "root")))


LOCAL = 1_000_000  # edges that one task contracts


def _contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges u, v, and the least node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: ``(node, root)`` for each node of an edge; the root is the least node.

    Distributed union-find. Each task first contracts up to LOCAL edges of its own to stars; where there are no more, this
    is the result. Else min-label propagation with pointer jumping joins the stars: each round takes the least label among
    neighbours (a combinable minimum, so a hub with very many edges is pre-aggregated before its shuffle) and then replaces
    each label by its label's label. Each round is cut, so a lost executor costs one round at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nodes, roots = _contract(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["u", "v"])

        for x in batches:
            held.append(x)
            if sum(y.num_rows for y in held) > 2 * LOCAL:
                yield flush()
                held = []
        if sum(y.num_rows for y in held):
            yield flush()

    links = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"))
    parts = links.count() // LOCAL + 1
    stars = cut(links.coalesce(parts).mapInArrow(run, "u long, v long"))
    if parts == 1:
        return stars.toDF("node", "root")
    both = stars.where("u <> v")
    both = cut(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("m"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        step = cut(step.join(up, "root", "left").select("node", "was", F.least("root", F.coalesce("higher", "root")).alias("root")))
        if step.where("was <> root").isEmpty():
            return step.select("node", "root")
        labels = step.select("node", "root")


BLOCK = 1 << 20  # bytes of sets in a block of a band's members


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All elements, sorted, and the set of each."""
    owner, flat = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    return flat[order], owner[order]


def _overlaps(mine: np.ndarray, postings: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Elements that ``mine`` shares with each of the ``n`` sets."""
    flat, owner = postings
    lo = np.searchsorted(flat, mine, "left")
    count = np.searchsorted(flat, mine, "right") - lo
    at = np.arange(int(count.sum())) + np.repeat(lo - np.cumsum(count) + count, count)
    return np.bincount(owner[at], minlength=n)


def _block_links(key: int, rows: list[tuple], to_sets: Callable[[list], list[np.ndarray]], least: float) -> Iterator[tuple[int, int]]:
    """Links of one block pair: rows (left, same, id, root, keys, payload). A pair is tested in the least band it shares."""
    left = [r for r in rows if r[0]]
    same = rows[0][1]
    right = left if same else [r for r in rows if not r[0]]
    if not left or not right or len({r[3] for r in rows}) < 2:
        return
    sets = to_sets([r[5] for r in right])
    others = sets if same else to_sets([r[5] for r in left])
    ids, roots, sizes = (np.array(x, np.int64) for x in ([r[2] for r in right], [r[3] for r in right], [len(x) for x in sets]))
    lesser = [np.array([k for k in r[4] if k < key], np.int64) for r in right]
    before, elements = _postings(lesser), _postings(sets)
    for i, (row, mine) in enumerate(zip(left, others, strict=True)):
        ok = (roots != row[3]) & (np.minimum(sizes, len(mine)) >= least * np.maximum(sizes, len(mine)))
        if same:
            ok[: i + 1] = False
        if ok.any():
            ok &= _overlaps(np.array([k for k in row[4] if k < key], np.int64), before, len(right)) == 0
        if ok.any():
            both = _overlaps(mine, elements, len(right))
            hit = np.flatnonzero(ok & (both / (sizes + len(mine) - both) >= least))
            for j in hit[np.unique(roots[hit], return_index=True)[1]]:  # one of each component joins all of it
                yield row[2], int(ids[j])


def across(members: DataFrame, payloads: DataFrame, to_sets: Callable[[list], list[np.ndarray]], least: float) -> DataFrame:
    """Verified edges ``a, b`` between members of one band whose components differ, by comparing every such pair.

    ``members``: distinct ``key, id, root, size``; ``payloads``: ``k, s`` with the set of each id, which ``to_sets`` reads.
    A band's members are dealt to blocks of about BLOCK bytes and each pair of blocks meets in one group. Members of the
    band's largest component don't meet each other, so a band of near copies costs what its other members cost.
    """
    per = members.groupBy("key", "root").agg(F.sum(F.col("size") * 8 + 64).alias("bytes"))
    per = per.groupBy("key").agg(F.max(F.struct("bytes", "root")).alias("top"), F.sum("bytes").alias("every")).where("every > top.bytes")
    mixed = per.select("key", F.col("top.root").alias("top"), F.ceil((F.col("every") - F.col("top.bytes")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("top.bytes") / BLOCK).cast("int").alias("many"))
    by_id = members.join(mixed, "key").groupBy("id").agg(F.first("root").alias("root"), F.collect_list(F.struct("key", "top", "few", "many")).alias("bands"))
    rows = by_id.join(payloads.withColumnRenamed("k", "id"), "id")
    rows = rows.select("id", "root", "s", F.transform("bands", lambda x: x["key"]).alias("keys"), F.explode("bands").alias("m")).select("id", "root", "s", "keys", "m.*")
    rare = F.col("root") != F.col("top")
    at = F.when(rare, F.pmod(F.xxhash64("id"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(rare, F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1).cast("int"))
    rows = rows.withColumn("at", at).withColumn("other", F.explode(meets)).withColumns({"x": F.least("at", "other"), "y": F.greatest("at", "other")})
    rows = rows.select(F.xxhash64("key", "x", "y").alias("deal"), "key", "x", "y", (F.col("at") == F.col("x")).alias("left"), (F.col("x") == F.col("y")).alias("same"), "id", "root", "keys", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[int, list[tuple]]]:
            now, held = None, []
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if row[:3] != now:
                        if held:
                            yield now[0], held
                        now, held = row[:3], []
                    held.append(row[3:])
            if held:
                yield now[0], held

        for key, held in groups():
            if found := list(_block_links(key, held, to_sets, least)):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("deal").sortWithinPartitions("deal", "key", "x", "y").select("key", "x", "y", "left", "same", "id", "root", "keys", "s")
    return cut(dealt.mapInArrow(run, "a long, b long"))


STAR_ROUNDS = 2


def linked(edges: DataFrame, verify: Callable[[DataFrame], DataFrame], sizes: DataFrame, payloads: DataFrame, to_sets: Callable[[list], list[np.ndarray]], least: float) -> DataFrame:
    """``node, root``: components of similar ids, from stars ``key, a, b`` of bands. ``verify`` adds ``ok`` to pairs ``a, b``;
    ``sizes`` has ``id, size`` of each id; ``payloads`` and ``to_sets`` are as in ``across``.

    Members of a band that failed against their centre meet another one. Then all pairs of a band whose ids ended in
    different components are compared, so two similar ids that share a band are always joined. A band of two is done
    after its first star.
    """
    spark = edges.sparkSession
    every, tested, failing = edges, None, None
    for left in reversed(range(STAR_ROUNDS)):
        pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        now = cut(verify(pairs))
        tested = now if tested is None else tested.union(now)
        if failing is None:  # bands of three or more whose star isn't one component
            bad = now.where("not ok").select(F.col("a").alias("x"), F.col("b").alias("y"))
            failed = edges.join(bad, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y"))).select("key", F.col("a").alias("id"))
            large = edges.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
            failing = cut(failed.join(large, "key", "left_semi"))
        if left:
            edges = cut(regroup(failing))
        release(spark)
    roots = components(tested.where("ok").select("a", "b"))
    release(spark)
    some = every.join(failing.select("key").distinct(), "key", "left_semi")
    members = some.select("key", F.col("a").alias("id")).union(some.select("key", F.col("b").alias("id"))).distinct()
    members = members.join(sizes, "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    more = across(cut(members.select("key", "id", "root", "size")), payloads, to_sets, least)
    out = joined(roots, more)
    release(spark)
    return out
