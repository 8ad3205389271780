"""Secrets: base patterns with exact places, and random-looking tokens found by a battery of tests. DataFrame operations only.

A token is a run of 16 or more characters of base64 or base64url with a digit or a change of case. Its encoding is inferred
from the characters it uses, which gives an alphabet. The battery asks whether its characters are drawn evenly and
independently from that alphabet: chi-squared of the kinds of characters and of the characters, runs about the alphabet's
middle, serial correlation at lag one. Fisher's method joins the four into one p-value, here the token's fit.

Short tokens fit by chance. How often, decoys tell: for each token, stretches of as many letters of the words around it are
written in its alphabet and take the same tests. A token's second p-value is the share of decoys, of its encoding and no
longer than itself, that fit as well; Benjamini and Hochberg's procedure in each stratum of encoding and length keeps the
false discoveries below RATE. All tokens and decoys count, different ones once.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.llm.common import cut, row_id

KINDS = ("assign", "access", "hex", "random")
BASE = 3  # kinds with a given pattern
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
VALUE = r"""^[A-Za-z_]++["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
#: Whole runs are matched greedily, so a least length inside the pattern drops what a test of the match would drop.
PATTERNS = (ASSIGN, r"AKIA[A-Z0-9]{12,}+", r"(?<![0-9a-f])[0-9a-f]{32,}+")
_C = r"[A-Za-z0-9+/_-]"
TOKEN = rf"(?<!{_C})(?={_C}*?(?:[0-9]|[a-z][A-Z])){_C}{{16,}}+"
LEAST_VALUE, RATE, LEAST_FIT, DECOYS, GRID, LAST_BAND = 8, 0.05, 0.001, 6, 1000, 20

_LOW, _UP, _DIG = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Encodings in the order in which they are tried: characters of a token, alphabet.
ENCODINGS = {
    "hex": (r"^[0-9a-f]++$", _DIG + "abcdef"), "HEX": (r"^[0-9A-F]++$", _DIG + "ABCDEF"), "base32": (r"^[A-Z2-7]++$", _UP + "234567"), "base36": (r"^[a-z0-9]++$", _DIG + _LOW),
    "base62": (r"^[A-Za-z0-9]++$", _UP + _LOW + _DIG), "base64": (r"^[A-Za-z0-9+/]++$", _UP + _LOW + _DIG + "+/"), "base64url": (r"^[A-Za-z0-9_-]++$", _UP + _LOW + _DIG + "-_"),
}


def _places(docs: DataFrame, patterns: list[tuple[int, str]], around: bool = False) -> DataFrame:
    """``r, kind, start, end, value``, and ``before, after`` if wanted: leftmost matches that don't overlap, by code points.

    Only texts in which a pattern occurs are split; starts are running sums over a document's matches of a kind.
    """
    text = F.col("text")
    each = [F.when(text.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("v"), F.split(text, p, -1).alias("g"))) for k, p in patterns]
    found = docs.select("r", F.explode(F.array_compact(F.array(*each))).alias("x")).select("r", "x.*")
    sides = [F.get("g", F.col("at")).alias("before"), *([F.get("g", F.col("at") + 1).alias("after")] if around else [])]
    rows = found.select("r", "kind", "g", F.posexplode("v").alias("at", "value")).select("r", "kind", "at", "value", *sides)
    rows = rows.withColumns({"gap": F.length("before"), "size": F.length("value")})
    if around:  # as much as decoys can need
        need = (F.col("size") * DECOYS + 200).cast("int")
        rows = rows.withColumns({"before": F.substr("before", F.greatest(F.lit(1), F.col("gap") - need)), "after": F.substr("after", F.lit(1), need)})
    rows = rows.dropDuplicates(["r", "kind", "at"])  # of rows given twice
    upto = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("r", "kind").orderBy("at"))
    out = rows.withColumn("end", upto.cast("int")).withColumn("start", (F.col("end") - F.col("size")).cast("int"))
    return out.select("r", "kind", "start", "end", "value", *(["before", "after"] if around else []))


def base_spans(docs: DataFrame) -> DataFrame:
    """Matches of the three given kinds that pass their tests: ``r, kind, start, end, value``."""
    found = _places(docs, list(enumerate(PATTERNS)))
    return found.where((F.col("kind") > 0) | (F.length(F.regexp_extract("value", VALUE, 1)) >= LEAST_VALUE))


def encoding(token: Column) -> Column:
    """The first encoding that holds all of a token's characters; none for digits alone, which are numbers."""
    out = F.when(token.rlike(r"^[0-9]++$"), F.lit(None).cast("string"))
    for name, (pattern, _) in ENCODINGS.items():
        out = out.when(token.rlike(pattern), name)
    return out


def _tail(z: Column) -> Column:
    """The share of a normal distribution above z, from 0 up."""
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return series * F.exp(-x * x) / 2


def _upper(z: Column) -> Column:
    return F.when(z < 0, 1 - _tail(-z)).otherwise(_tail(z))


def _count(token: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(token, kept, "")).cast("double")


def _kinds(token: Column, n: Column, name: str) -> Column:
    """Chi-squared of lower case, upper case, digits and other characters of one encoding, as a normal deviate."""
    alphabet, total = ENCODINGS[name][1], None
    kinds = [(p, sum(c in s for c in alphabet)) for p, s in (("[^a-z]", _LOW), ("[^A-Z]", _UP), ("[^0-9]", _DIG), ("[A-Za-z0-9]", "+/-_"))]
    kinds = [(p, k) for p, k in kinds if k]
    for pattern, k in kinds:
        due = n * (k / len(alphabet))
        one = F.pow(_count(token, pattern) - due, F.lit(2)) / due
        total = one if total is None else total + one
    df = len(kinds) - 1
    return (F.pow(total / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))


def fit(tokens: DataFrame) -> DataFrame:
    """``tokens`` (``token, code``, the encoding) with ``fit``: the joint p-value of the four tests; ``size``, its characters."""
    names = list(ENCODINGS)
    by_name = lambda f: F.coalesce(*(F.when(F.col("code") == x, f(x)) for x in names))
    rows = tokens.withColumn("size", F.length("token")).withColumn("alphabet", by_name(lambda x: F.lit(ENCODINGS[x][1])))
    n, a, token = F.col("size").cast("double"), F.length("alphabet").cast("double"), F.col("token")
    squares = F.aggregate(F.sequence(F.lit(1), F.length("alphabet")), F.lit(0.0), lambda s, k: s + F.pow(n - F.length(F.replace(token, F.substr("alphabet", k, F.lit(1)), F.lit(""))), F.lit(2)))
    even = (a / n * squares - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    halves = by_name(lambda x: F.translate(token, ENCODINGS[x][1], "0" * (len(ENCODINGS[x][1]) // 2) + "1" * (len(ENCODINGS[x][1]) // 2)))
    rows = rows.withColumns({"even": even, "kinds": by_name(lambda x: _kinds(token, n, x)), "halves": halves, "values": F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.col("alphabet"), c).cast("double"))})
    ones = _count(F.col("halves"), "0")
    runs = F.length(F.regexp_replace("halves", r"(.)\1++", "$1")).cast("double")
    due = 2 * ones * (n - ones) / n + 1
    spread = (due - 1) * (due - 2) / (n - 1)
    none = F.struct(*(F.lit(0.0).alias(c) for c in ("last", "sum", "square", "lag")))
    sums = F.aggregate("values", none, lambda s, v: F.struct(v.alias("last"), (s["sum"] + v).alias("sum"), (s["square"] + v * v).alias("square"), (s["lag"] + s["last"] * v).alias("lag")))
    rows = rows.withColumns({"runs": F.when(spread > 0, F.abs(runs - due) / F.sqrt(spread)).otherwise(9.0), "s": sums})
    first, last, mean = F.get("values", F.lit(0)), F.col("s.last"), F.col("s.sum") / n
    lag = F.col("s.lag") - mean * (2 * F.col("s.sum") - first - last) + (n - 1) * mean * mean
    varied = F.col("s.square") - n * mean * mean
    rows = rows.withColumn("serial", F.when(varied > 1e-9, F.abs(lag / varied + 1 / n) * F.sqrt(n)).otherwise(9.0))
    p = [_upper(F.col("even")), _upper(F.col("kinds")), 2 * _tail(F.col("runs")), 2 * _tail(F.col("serial"))]
    half = -(F.ln(F.greatest(p[0], F.lit(1e-300))) + F.ln(F.greatest(p[1], F.lit(1e-300))) + F.ln(F.greatest(p[2], F.lit(1e-300))) + F.ln(F.greatest(p[3], F.lit(1e-300))))
    rows = rows.withColumn("half", half)
    h = F.col("half")
    return rows.withColumn("fit", F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)).select(*tokens.columns, "size", "fit")


def candidates(docs: DataFrame) -> DataFrame:
    """Tokens with an encoding: ``r, start, end, token, code, before, after``."""
    found = _places(docs, [(0, TOKEN)], around=True).withColumn("code", encoding(F.col("value")))
    return found.where("code is not null").select("r", "start", "end", F.col("value").alias("token"), "code", "before", "after")


def decoys(found: DataFrame) -> DataFrame:
    """``token, code``: up to DECOYS stretches of each token's length of the words around it without digits, in its alphabet."""
    near = F.regexp_replace(F.concat_ws(" ", "before", "after"), r"\S*[0-9]\S*", "")
    letters = F.regexp_replace(near, "[^A-Za-z]", "")
    mixed = _LOW + _UP
    written = F.when(F.col("code") == "base32", F.upper(letters)).when(F.col("code") == "base36", F.lower(letters))
    for name in ("hex", "HEX"):
        written = written.when(F.col("code") == name, F.translate(letters, mixed, "".join(ENCODINGS[name][1][ord(c) % 16] for c in mixed)))
    n = F.length("token")
    rows = found.select("code", n.alias("n"), written.otherwise(letters).alias("w"))
    rows = rows.withColumn("k", F.least(F.lit(DECOYS), F.floor(F.length("w") / F.col("n"))).cast("int")).where("k > 0")
    return rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.substr("w", i * F.col("n") + 1, F.col("n")))).alias("token"), "code")


def limits(scored: DataFrame, rate: float = RATE) -> DataFrame:
    """``code, band, least``: the least grid fit in each stratum at which false discoveries stay below ``rate``.

    ``scored``: ``token, code, band, at, decoy``. Counts are of different tokens; after them no table here has more rows than
    encodings, bands and grid have cells.
    """
    cells = scored.groupBy("code", "band", "at", "decoy").agg(F.count_distinct(F.xxhash64("token"), F.xxhash64(F.lit(7), "token")).alias("n"))
    longer = cells.where("decoy").select("code", F.explode(F.sequence(F.col("band"), F.lit(LAST_BAND))).alias("band"), "at", "n")
    both = cells.where("not decoy").select("code", "band", "at", F.col("n").alias("tokens"), F.lit(0).cast("long").alias("decoys")).union(longer.select("code", "band", "at", F.lit(0).cast("long"), "n"))
    both = both.groupBy("code", "band", "at").agg(F.sum("tokens").alias("tokens"), F.sum("decoys").alias("decoys"))
    down, every = W.partitionBy("code", "band").orderBy(F.desc("at")), W.partitionBy("code", "band")
    p = (1 + F.sum("decoys").over(down)) / (1 + F.sum("decoys").over(every))
    rank = F.try_divide(F.sum("tokens").over(down), F.sum("tokens").over(every))
    return both.withColumn("p", p).withColumn("rank", rank).where(F.col("p") <= rate * F.col("rank")).groupBy("code", "band").agg(F.min("at").alias("least"))


def discover(base: DataFrame, found: DataFrame, rate: float = RATE) -> DataFrame:
    """``r, kind, start, end`` of the ``found`` tokens that pass and that no base span touches."""
    told = fit(found.select("r", "start", "end", "token", "code", F.lit(False).alias("decoy")).unionByName(decoys(found).withColumn("decoy", F.lit(True)), allowMissingColumns=True))
    band = F.least(F.lit(LAST_BAND), F.floor(F.log2("size") * 2)).cast("int")
    told = cut(told.withColumns({"band": band, "at": F.floor(F.col("fit") * GRID).cast("int")}))
    good = told.where("not decoy").join(F.broadcast(limits(told, rate)), ["code", "band"])  # a row a stratum
    good = good.where((F.col("at") >= F.col("least")) & (F.col("fit") >= LEAST_FIT)).select("r", F.lit(BASE).alias("kind"), "start", "end")
    both = base.select("r", "kind", "start", "end").join(good.select("r").distinct(), "r", "left_semi").union(good)
    of_base = F.col("kind") < BASE
    at = W.partitionBy("r").orderBy("start")
    before = F.max(F.when(of_base, F.col("end"))).over(at.rangeBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(of_base, F.col("start"))).over(at.rangeBetween(0, W.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return both.withColumn("free", free).where(~of_base & F.col("free")).select("r", "kind", "start", "end")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("r", F.struct(*row_id()))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, start, end`` of all secrets, as ``report`` counts them; once for rows given twice."""
    keyed = _keyed(docs)
    texts = keyed.select("r", "text")
    found = cut(base_spans(texts).select("r", "kind", "start", "end"))
    spans = found.union(discover(found, cut(candidates(texts))))
    names = F.array(*map(F.lit, KINDS))
    return keyed.select("doc_id", "r").distinct().join(spans, "r").select("doc_id", F.element_at(names, F.col("kind") + 1).alias("kind"), "start", "end")


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts of base spans (``n_assign, n_access, n_hex``), their digest, all spans, and the number of
    those that the tests added (``n_found``).

    Null and empty texts have none; an empty table gives no rows. Repeated rows get the same result. Only doc_id and text
    are looked at. A corpus with fewer decoys than 1 / RATE in a stratum adds nothing there.
    """
    keyed = _keyed(docs)
    texts = keyed.select("r", "text")
    found = cut(base_spans(texts).select("r", "kind", "start", "end"))
    added = discover(found, cut(candidates(texts)))
    one = F.struct("start", "kind", "end")
    base = found.groupBy("r").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{n}") for k, n in enumerate(KINDS[:BASE])), F.collect_list(one).alias("base"))
    more = added.groupBy("r").agg(F.collect_list(one).alias("more"))
    out = keyed.select("doc_id", "r").join(base, "r", "left").join(more, "r", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans, rest = F.coalesce("base", none), F.coalesce("more", none)
    return out.select(
        "doc_id", *(F.coalesce(f"n_{n}", F.lit(0).cast("long")).alias(f"n_{n}") for n in KINDS[:BASE]),
        F.sha2(_joined(spans), 256).alias("base_sha256"), _joined(F.concat(spans, rest)).alias("spans"), F.size(rest).cast("long").alias("n_found"),
    )
