"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, thresholds by language.

The model is of order 4 over 16-bit symbols: each code point is one (those beyond 0xFFFF share 2,048), so an n-gram is a
long. Counts are of all trusted texts but those held out and stay sharded by n-gram; so do the shares and back-off weights, which are joins
of counts (n-gram with context, n-gram with suffix). Documents are dealt to buckets of about BUCKET_BYTES; the distinct
n-grams of a bucket are joined with the model's shards, and what comes back scores the bucket's texts. Nothing of the
model is collected or broadcast, and all of it grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.llm import common
from gaugeworks.llm.common import cut

ORDER, BITS = 4, 16
QUANTILE = 0.999
SHRINK = 100  # symbols at the median of trusted texts that each text gets, so that short ones aren't judged on noise
BUCKET_BYTES = 48 << 20
FOLDS = 5  # one of so many trusted documents isn't counted: it shows what unseen good text scores, and sets the thresholds
SALTS = 4  # a doc_id given very often is dealt to so many buckets
CHUNK = 1 << 20


def symbols(text: str) -> np.ndarray:
    """Three edges, the text's symbols, one edge. The edge is 0; code points beyond 0xFFFF fall into the surrogates' range."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() > 0xFFFF:
        points = np.where(points > 0xFFFF, 0xD800 + (points * np.uint32(0x9E3779B1) >> np.uint32(21)), points)
    out = np.zeros(len(points) + ORDER, np.uint64)
    out[ORDER - 1 : -1] = points
    return out


def grams(text: str) -> np.ndarray:
    s = symbols(text)
    g = s[3:].copy()
    for i in (1, 2, 3):
        g |= s[3 - i : -i] << np.uint64(BITS * i)
    return g.view(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return g, np.bincount(at, np.concatenate([c for _, c in parts]), len(g)).astype(np.int64)


def _counts(texts: Iterator[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts, and their counts in those marked True."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held: dict[bool, list[np.ndarray]] = {True: [], False: []}
    size = {True: 0, False: 0}

    def flush(mark: bool) -> None:
        if held[mark]:
            g, c = np.unique(np.concatenate(held[mark]), return_counts=True)
            parts.append((g, c if mark else np.zeros(len(g), np.int64)))
            held[mark], size[mark] = [], 0
            if len(parts) > 15:
                parts[:] = [_summed(parts)]

    for text, mark in texts:
        held[mark].append(grams(text))
        size[mark] += len(held[mark][-1])
        if size[mark] > CHUNK:
            flush(mark)
    flush(True)
    flush(False)
    return _summed(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def _held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(FOLDS)) == 0


def _dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """``r, q, doc_id, lang, text, bucket``, dealt by bucket, and the number of buckets. A bucket follows from doc_id and text."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(total // BUCKET_BYTES + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (BUCKET_BYTES // 4) + 1))
    r, q = common.row_id()
    salt = F.pmod(F.xxhash64("text"), F.lit(SALTS))
    spot = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("string"), salt))
    x = docs.select(r.alias("r"), q.alias("q"), "doc_id", "lang", "text", F.pmod(spot, F.lit(n)).cast("int").alias("bucket"))
    return x.repartition(n, "bucket"), n


def count_grams(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``g, c``: each n-gram of any text, with its count in the trusted texts that aren't held out (0 if only others have it); summed in each bucket before the shuffle."""
    x, n = _dealt(docs)
    ids = _trusted(labels).where(~_held_out()).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    ids = ids.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("salt").cast("long")), F.lit(n)).cast("int").alias("bucket")).distinct()

    def run(texts: pa.Table, trusted: pa.Table) -> pa.Table:
        good = set(trusted.column("doc_id").to_pylist())
        rows = ((t or "", i in good) for c in texts.select(["doc_id", "text"]).to_batches() for i, t in zip(c.column(0).to_pylist(), c.column(1).to_pylist(), strict=True))
        g, c = _counts(rows)
        return pa.table({"g": g, "c": c})

    both = x.groupBy("bucket").cogroup(ids.groupBy("bucket")).applyInArrow(run, "g long, c long")
    return both.groupBy("g").agg(F.sum("c").alias("c"))


def _low(n: int) -> int:
    return (1 << BITS * n) - 1


def _key(n: int, g: Column | str = "g") -> Column:
    """The last ``n`` symbols of an n-gram."""
    g = F.col(g) if isinstance(g, str) else g
    return g if n == ORDER else g.bitwiseAND(F.lit(_low(n)))


def _context(g: str) -> Column:
    return F.shiftrightunsigned(g, BITS)


def discounts(few: dict[int, int]) -> list[float]:
    """Three discounts (for counts of 1, 2 and more) from the numbers of n-grams with counts 1 to 4; half a count's worth where these are missing."""
    n1, n2, n3, n4 = (few.get(i, 0) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return [max(0.0, min(k, k - (k + 1) * y * b / a)) if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def model(counts: DataFrame) -> DataFrame:
    """``g, p``: the probability of the last symbol of each n-gram after the others, of all those in ``counts``.

    Counts of lower orders are of distinct left neighbours. Each order's shares are joins of n-grams with their contexts;
    each probability joins its context's weight and its suffix' probability.
    """
    seen = counts.where("c > 0")
    tables = {ORDER: seen}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = cut(tables[n + 1].select(_key(n).alias("g")).groupBy("g").agg(F.count("*").alias("c")))
    p: DataFrame | None = None
    for n in range(1, ORDER + 1):
        t = tables[n]
        d = discounts({r.c: r.n for r in t.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()})
        each = [F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long")), F.sum((F.col("c") > 2).cast("long"))]
        left = t.groupBy(_context("g").alias("h")).agg(F.sum("c").alias("total"), sum((x * F.lit(v) for x, v in zip(each, d, strict=True)), F.lit(0.0)).alias("off"))
        wanted = counts.select(_key(n).alias("g")).distinct() if n < ORDER else counts.select("g")
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        out = wanted.join(t.select("g", "c", off.alias("d")), "g", "left").withColumn("h", _context("g")).join(left, "h", "left")
        share = F.coalesce((F.col("c") - F.col("d")) / F.col("total"), F.lit(0.0))
        gamma = F.coalesce(F.col("off") / F.col("total"), F.lit(1.0))
        if p is None:
            out = out.select("g", (share + gamma / float(1 << BITS)).alias("p"))
        else:
            out = out.withColumn("s", _key(n - 1)).join(p.select(F.col("g").alias("s"), F.col("p").alias("lower")), "s").select("g", (share + gamma * F.col("lower")).alias("p"))
        p = cut(out)
    return p


def score(docs: DataFrame, probabilities: DataFrame) -> DataFrame:
    """``r, q, doc_id, lang, bits, n`` for each row of ``docs``: the sum of -log2 P and the number of symbols with the end."""
    x, _ = _dealt(docs)
    kind = dict(docs.dtypes)["doc_id"]

    def ask(texts: pa.Table) -> pa.Table:
        g, _ = _counts((t or "", False) for c in texts.select(["text"]).to_batches() for t in c.column(0).to_pylist())
        return pa.table({"bucket": pa.array(np.full(len(g), texts.column("bucket")[0].as_py(), np.int32)), "g": g})

    asked = x.groupBy("bucket").applyInArrow(ask, "bucket int, g long")
    told = asked.join(probabilities, "g").select("bucket", "g", (-F.log2("p")).cast("float").alias("cost"))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        g, cost = answers.column("g").to_numpy(), answers.column("cost").to_numpy()
        order = np.argsort(g)
        g, cost = g[order], cost[order].astype(np.float64)
        bits, n = np.zeros(texts.num_rows), np.zeros(texts.num_rows, np.int64)
        for i, t in enumerate(texts.column("text")):
            own, c = np.unique(grams(t.as_py() or ""), return_counts=True)
            bits[i], n[i] = (cost[np.searchsorted(g, own)] * c).sum(), c.sum()
        return pa.table({**{k: texts.column(k) for k in ("r", "q", "doc_id", "lang")}, "bits": bits, "n": n})

    schema = f"r long, q long, doc_id {kind}, lang string, bits double, n long"
    return x.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, schema)


def thresholds(scores: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``lang, median, limit`` in millibits a symbol from the trusted texts held out (from all, if none is); row ``lang`` = null-safe language, and the row '*' for all.

    Bits are counted in bins of a thousandth, at most about 100,000, so the running sums over a language are bounded.
    """
    trusted = cut(scores.join(_trusted(labels), "doc_id").select("doc_id", "lang", "bits", "n"))
    apart = trusted.where(_held_out())
    trusted = trusted if apart.isEmpty() else apart
    rate = F.floor(F.col("bits") / F.col("n") * 1000)

    def at(df: DataFrame, value: Column, q: float, name: str) -> DataFrame:
        both = df.select("lang", value.alias("bin")).withColumn("lang", F.explode(F.array(F.coalesce("lang", F.lit("?")), F.lit("*"))))
        bins = both.groupBy("lang", "bin").agg(F.count("*").alias("n"))
        w = W.partitionBy("lang")
        run = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
        return run.where(F.col("upto") >= F.ceil(F.col("all") * q)).groupBy("lang").agg(F.min("bin").alias(name))

    middle = at(trusted, rate, 0.5, "median")
    shrunk = trusted.withColumn("key", F.coalesce("lang", F.lit("?"))).join(middle.withColumnRenamed("lang", "key"), "key")
    limit = at(shrunk, F.floor((F.col("bits") * 1000 + F.col("median") * SHRINK) / (F.col("n") + SHRINK)), quantile, "limit")
    return middle.join(limit, "lang")


def judge(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``rate`` (millibits a symbol, shrunk), ``limit`` and ``keep``; a language without trusted texts takes the limit of all.

    Without any trusted text nothing is rejected.
    """
    own = limits.select(F.col("lang").alias("own"), F.col("median").alias("m"), F.col("limit").alias("l"))
    every = limits.where("lang = '*'").select(F.max("median").alias("am"), F.max("limit").alias("al"))
    out = scores.withColumn("own", F.coalesce("lang", F.lit("?"))).join(own, "own", "left").crossJoin(F.broadcast(every))  # one row
    median = F.coalesce("m", "am", F.lit(0))
    rate = F.floor((F.col("bits") * 1000 + median * SHRINK) / (F.col("n") + SHRINK))
    out = out.withColumns({"rate": rate, "limit": F.coalesce("l", "al")}).drop("own", "m", "l", "am", "al")
    return out.withColumn("keep", F.coalesce(F.col("rate") <= F.col("limit"), F.lit(True)))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``r, q, doc_id, lang, bits, n, rate, limit, keep`` for each row of ``docs``."""
    spark = docs.sparkSession
    plain = docs.select("doc_id", "lang", "text")
    p = model(cut(count_grams(plain, labels)))
    common.release(spark)
    scores = cut(score(plain, p))
    common.release(spark)
    return judge(scores, cut(thresholds(scores, labels, quantile)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, n_symbols, perplexity, millibits, limit, keep`` for each row of ``docs``.

    Null and empty texts have one symbol (the end) and are judged by it; an empty table gives no rows. Repeated rows are
    judged alike; labels given twice count once; columns other than doc_id, text, lang are not looked at.
    """
    out = judged(docs, labels)
    return out.select("doc_id", "lang", F.col("n").alias("n_symbols"), F.round(F.pow(F.lit(2.0), F.col("bits") / F.col("n")), 4).alias("perplexity"), F.col("rate").alias("millibits"), "limit", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their own columns, whatever their names; odd rows as in ``report``."""
    bad = cut(judged(docs, labels).where("not keep").select("r", "q").distinct())
    r, q = common.row_id()
    kr, kq = common.fresh(docs.columns, "_r", "_q")
    named = docs.withColumns({kr: r, kq: q})
    return named.join(bad.toDF(kr, kq), [kr, kq], "left_anti").select(*(f"`{c}`" for c in docs.columns))
