"""Personal data: base patterns with exact places, and bootstrapped contextual extraction. DataFrame operations only.

Base matches seed a graph of instances (mentions: runs of ASCII or Latin characters with a digit or @, and phone- or
card-like runs with blanks) and lexical patterns (the word before with the mention's kind of characters, the same with its
loose shape, the word after with that, and the exact shape alone). So do values of the kind ``secret``, by a strict form alone: a name, ``=``, and between quotes,
with nothing but blanks behind, a run of 12 or more that mixes letters and digits. No word is a cue by itself: which words
and shapes stand by identifiers is what the patterns learn. They are scored by the share of their occurrences that are known
for a kind, instances by their best pattern, in turns; what scores enough is known in the next turn. Unseen identifiers
found so are added as spans, as are seeds of the kind ``secret``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.llm.common import cut, row_id

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4  # kinds with a given pattern
#: The given patterns with possessive repeats where nothing is given back, and no starts inside a run that failed already.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_T = r"[!#-&(-+\--:?-Z\\^-z~\u00C0-\u024F]"  # a mention's characters: graphic ones but quotes, commas, brackets, braces and = ; < > |
_FREE = r"[!#-&(-+\--/:?A-Z\\^-z~\u00C0-\u024F]"  # those but digits and @
MENTION = rf"(?<!{_T})(?:\+[0-9][\x20().0-9-]+[0-9](?!{_T})|[0-9](?:[\x20-]?[0-9])++(?!{_T})|{_FREE}*+[0-9@]{_T}*+)"
LAST_WORD = r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_]++)([^\p{L}\p{N}_]*+)$"
FIRST_WORD = r"^[^\p{L}\p{N}_]*+([\p{L}\p{N}_]++)"
TURNS, LEAST_SCORE, LEAST_SEEDS = 3, 0.7, 3
ASSIGNED, CLOSED = r"^\x20?=\x20?[\"']$", r"^[\"'](?:\s|\z)"  # what stands before and behind a seed of the kind secret
NEAR = 256  # spans are matched with mentions by stretches of so many characters
LONG = 80  # a longer name of an instance or pattern is replaced by its digest


def _places(docs: DataFrame, patterns: list[tuple[int, str]], around: bool = False) -> DataFrame:
    """``r, kind, start, end, value``: leftmost matches that don't overlap, by code points; ``around``: the text up to the
    match before and after too.

    Matches and the text between them alternate; starts are running sums over a document's matches of a kind.
    """
    text = F.col("text")
    found = docs.where(text.rlike("[0-9@]")).select("r", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("v"), F.split(text, p, -1).alias("g")) for k, p in patterns))).alias("x"))
    found = found.select("r", "x.*").where(F.size("v") > 0)
    rows = found.select("r", "kind", "g", F.posexplode("v").alias("at", "value")) if around else found.select("r", "kind", F.posexplode(F.arrays_zip("v", F.slice("g", 1, F.size("v")).alias("g"))).alias("at", "m")).select("r", "kind", "at", F.col("m.v").alias("value"), F.col("m.g").alias("before"))
    if around:
        rows = rows.select("r", "kind", "at", "value", F.get("g", F.col("at")).alias("before"), F.get("g", F.col("at") + 1).alias("after"))
        last, first = (F.regexp_extract("before", LAST_WORD, i) for i in (1, 2)), F.regexp_extract("after", FIRST_WORD, 1)
        rows = rows.withColumns({"word": next(last), "link": next(last), "next": first, "behind": F.substring("after", 1, 2)})
    rows = rows.select("r", "kind", "at", "value", F.length("before").alias("gap"), F.length("value").alias("size"), *(["word", "link", "next", "behind"] if around else []))
    rows = rows.dropDuplicates(["r", "kind", "at"])  # of rows given twice
    upto = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("r", "kind").orderBy("at"))
    out = rows.withColumn("end", upto.cast("int")).withColumn("start", (F.col("end") - F.col("size")).cast("int"))
    return out.select("r", "kind", "start", "end", "value", *(["word", "link", "next", "behind"] if around else []))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def base_spans(docs: DataFrame) -> DataFrame:
    """Matches of the four kinds that pass their tests: ``r, kind, start, end, value``."""
    found = _places(docs, list(enumerate(PATTERNS)))
    digits = _digits(F.col("value"))
    n = F.length(digits)
    part = F.transform(F.split("value", r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    ip = F.forall(part, lambda x: (F.length(x) <= 3) & (F.substring(x, 1, 3).cast("int") <= 255))
    card = F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    good = F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, F.when(F.col("kind") == 1, ip)).when(F.col("kind") == 2, card).otherwise(n.between(9, 15))
    return found.where(good)


def _name(x: Column) -> Column:
    return F.when(F.length(x) > LONG, F.sha2(x, 256)).otherwise(x)


def shape(token: Column) -> Column:
    """Runs of letters become a, each digit 9, and a run of 12 or more that mixes both X with its length."""
    mixed = r"(?<![A-Za-z0-9])(?=[A-Z]*+[0-9]++[A-Z]|[a-z]*+[0-9]++[a-z]|[A-Za-z]++[0-9])[A-Za-z0-9]{12,}+"
    size = F.length(F.regexp_extract(token, mixed, 0)).cast("string")
    low = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, mixed, "\u0001"), r"\p{L}++", "a"), "[0-9]", "9")
    return F.regexp_replace(low, "\u0001", F.concat(F.lit("X"), size))


def candidates(docs: DataFrame) -> DataFrame:
    """Mentions: ``r, start, end, instance, named, patterns``. The instance is the mention without punctuation at its ends;
    ``named`` says that it has the strict form of a secret."""
    t = _places(docs, [(0, MENTION)], around=True)
    lead = F.regexp_extract("value", r"^([^\p{L}\p{N}+(]*+)", 1)
    instance = F.regexp_replace(F.regexp_replace("value", r"^[^\p{L}\p{N}+(]++", ""), r"(?<=[\p{L}\p{N})])[^\p{L}\p{N})]++$", "")
    word = F.lower("word")
    t = t.withColumns({"instance": instance, "start": (F.col("start") + F.length(lead)).cast("int")}).where("instance <> ''")
    t = t.withColumns({"end": (F.col("start") + F.length("instance")).cast("int"), "form": shape(F.col("instance"))})
    named = F.col("word").rlike("^[A-Za-z]") & F.col("link").rlike(ASSIGNED) & F.col("behind").rlike(CLOSED) & F.col("form").contains("X")
    loose = F.regexp_replace("form", r"9++|X9++", "9")
    kind = F.when(F.col("instance").contains("@"), "@").when(F.col("instance").rlike(r"\p{L}"), "x").otherwise("9")
    told = [F.concat_ws(" ", word, kind, F.lit("<<")), F.concat_ws(" ", word, loose, F.lit("<")), F.concat_ws(" ", loose, F.lower("next"), F.lit(">")), F.concat(F.col("form"), F.lit(" ="))]
    return t.select("r", "start", "end", _name(F.col("instance")).alias("instance"), named.alias("named"), F.array(*map(_name, told)).alias("patterns"))


def _stretches(start: str, end: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / NEAR), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / NEAR)))


def discover(found: DataFrame, mentions: DataFrame) -> DataFrame:
    """``r, kind, start, end, named``: mentions whose instance the graph comes to know, but those that a base span covers by half or more (these are its seeds)."""
    b = found.select("r", "kind", F.col("start").alias("s"), F.col("end").alias("e")).withColumn("near", _stretches("s", "e"))
    c = mentions.withColumn("near", _stretches("start", "end"))
    shared = F.least("e", "end") - F.greatest("s", "start")
    met = c.join(b, ["r", "near"]).where(shared * 2 >= F.col("end") - F.col("start")).select("r", "start", "instance", "kind").distinct()
    met = cut(met)
    named = mentions.where("named").select("r", "start", "instance", F.lit(BASE).alias("kind")).join(met.select("r", "start"), ["r", "start"], "left_anti")
    known = cut(met.select("instance", "kind").union(named.select("instance", "kind")).distinct().withColumn("score", F.lit(1.0)))
    edges = cut(mentions.select("instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.count("*").alias("n")))
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    for _ in range(TURNS):
        share = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hit"), F.count("*").alias("seeds"))
        good = share.where(F.col("seeds") >= LEAST_SEEDS).join(totals, "pattern").select("pattern", "kind", (F.col("hit") / (F.col("total") + 1)).alias("score")).where(F.col("score") >= LEAST_SCORE)
        reached = edges.join(good, "pattern").groupBy("instance", "kind").agg(F.max("score").alias("score"))
        known = cut(known.unionByName(reached).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    best = known.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select("instance", (-F.col("b.k")).alias("kind"))
    free = mentions.join(met.select("r", "start").distinct(), ["r", "start"], "left_anti")
    return free.join(best, "instance").select("r", "kind", "start", "end", "named")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts of base spans by kind (``n_email`` to ``n_phone``), their digest, all spans, the number of
    spans that discovery added (``n_found``), and of those the ones that patterns found, not seeds (``n_learned``).

    Null and empty texts have none; an empty table gives no rows. Repeated rows get the same result. Only doc_id and text
    are looked at.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("r", F.struct(*row_id()))
    texts = keyed.select("r", "text")
    found = cut(base_spans(texts))
    added = discover(found.drop("value"), cut(candidates(texts)))
    one = F.struct("start", "kind", "end")
    base = found.groupBy("r").agg(*(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{n}") for k, n in enumerate(KINDS[:BASE])), F.collect_list(one).alias("base"))
    more = added.groupBy("r").agg(F.collect_set(one).alias("more"), F.count_distinct(F.when(~F.col("named"), one)).alias("learned"))
    out = keyed.select("doc_id", "r").join(base, "r", "left").join(more, "r", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans, rest = F.coalesce("base", none), F.coalesce("more", none)
    return out.select(
        "doc_id", *(F.coalesce(f"n_{n}", F.lit(0).cast("long")).alias(f"n_{n}") for n in KINDS[:BASE]),
        F.sha2(_joined(spans), 256).alias("base_sha256"), _joined(F.concat(spans, rest)).alias("spans"), F.size(rest).cast("long").alias("n_found"),
        F.coalesce("learned", F.lit(0).cast("long")).alias("n_learned"),
    )
