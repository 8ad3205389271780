"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for each operator and stage."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from oracle import same

from gaugeworks.llm import bpe, decontaminate, lines, media, neardup, pii, quality, queries, spans, toxicity, urls

SF = "/root/testdata/sf0.001"
TEXTS = [(1, None), (2, ""), (3, " \n\n "), (4, "É a. b! c?\nx"), (4, "É a. b! c?\nx"), (None, "null id"), (None, None), (5, "ab " * 40_000), (6, "z" * 50_000), (7, "漢字🙂 " * 50)]
CLASH = "_r _q _gone _lines _removed _sentences _spans _words _items _key _limit k h a b key root kind x y z deal data places bucket g p c r q ord bits n rate limit keep own lists blocked day seat score toxic quality fold media ids decoded n_bytes".split()


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "xx", *(f"{c}{at}" for c in CLASH)) for at, (i, t) in enumerate(TEXTS)], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH))


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (4, 0, None), (4, 1, 1), (5, None, 0), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


ITEMS = [(1, "ab ab ab"), (None, "null id"), (3, None), (4, ""), (4, "zz z")]


def keepers(spark, labels):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {
        "lines": lines.clean, "lines_all": lines.dedup, "spans": spans.dedup, "neardup": neardup.keep_one, "quality": lambda d: quality.keep_good(d, labels),
        "decontaminate": lambda d: decontaminate.clean(d, items), "decontaminate_all": lambda d: decontaminate.find(d, items),
    }


@pytest.mark.parametrize("name", ["lines", "lines_all", "spans", "neardup", "quality", "decontaminate", "decontaminate_all"])
def test_columns_of_any_name_stay(spark, odd, labels, name):
    f = keepers(spark, labels)[name]
    out = f(odd)
    rows = out.select(*odd.columns).toPandas().to_dict("records")
    assert out.columns[: len(odd.columns)] == odd.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    for r in rows:
        at = int(r["data"][4:])
        assert all(r[c] == f"{c}{at}" for c in CLASH)
    ids = Counter(int(r["data"][4:]) for r in rows)
    if name == "neardup":  # one of the wordless texts, one row of doc 4, all rows without id
        assert sorted(ids) == [0, 3, 5, 6, 7, 8, 9] or sorted(ids) == [0, 4, 5, 6, 7, 8, 9]
    elif name == "decontaminate":  # doc 5 is all item 1; a null item id hits too
        assert sorted(ids) == [0, 1, 2, 3, 4, 6, 8, 9]
    elif name != "quality":
        assert ids == Counter(range(len(TEXTS)))
        texts = {int(r["data"][4:]): r["text"] for r in rows}
        assert texts[0] is None and texts[1] == "" and texts[3] == texts[4] == TEXTS[3][1]
    assert f(odd.limit(0)).count() == 0


def test_reports_of_odd_rows(spark, odd, labels):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    reports = {
        "op2": spans.report, "op3": lambda d: media.read_features(media.store(d)), "op4": lines.report, "op5": lambda d: quality.report(d, labels), "op6": neardup.classes,
        "op7": pii.report, "op8": lambda d: decontaminate.report(d, items), "op9": lambda d: bpe.digests(d, P.path(queries.RANKS), P.PATTERN), "op10": lambda d: toxicity.report(d, labels),
    }
    for name, f in reports.items():
        got = [tuple(str(v) for v in r) for r in f(odd).collect()]
        assert len(got) == len(TEXTS), name
        assert Counter(got).most_common(1)[0][1] >= 2, name  # repeated rows get one result
        assert f(odd.limit(0)).count() == 0, name
    rows = {r.doc_id: r for r in decontaminate.report(odd, items).collect()}
    assert rows[None].n_items == 0 and {r.n_hit for r in decontaminate.report(odd, items).where("doc_id is null").collect()} == {0, 2}


def test_urls_with_clashing_columns(spark):
    c = spark.createDataFrame([("http://a.com", 5, "x", "y", "z")], "url string, day long, lists string, blocked string, key string")
    e = spark.createDataFrame([("l", "d:a.com", 1, "add")], "list string, key string, day long, action string")
    (row,) = urls.judge(c, e).collect()
    assert row.asDict() == {"url": "http://a.com", "day": 5, "lists": "x", "blocked": "y", "key": "z", "lists_": ["l"], "blocked_": True}
    assert urls.judge(c.limit(0), e).count() == 0 and urls.judge(c, e.limit(0)).first()["blocked_"] is False


def test_decontamination_sql(spark):
    same(spark, queries.op8_decontamination, queries.OP8_SQL, SF)


def test_media_and_bpe_contracts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in queries.op3_media_columns(spark, SF).collect():
        raw = texts[r.doc_id]
        full = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        stored = media.encode(media.pad(raw))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and r.feature
    ranks = bpe.Encoder(open(P.path(queries.RANKS), "rb").read(), P.PATTERN).ranks
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op9_byte_bpe(spark, SF).collect():
        ids = np.array(lib.encode_ordinary(texts[r.doc_id].decode()), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id]).hexdigest())


def test_bpe_other_pattern():
    enc = bpe.Encoder(open(P.path(queries.RANKS), "rb").read(), r"(?s)..?.?")
    assert enc.decode(enc.encode("a b  c é\n")) == "a b  c é\n".encode()


def kneser_ney(texts, trusted):
    """Probability of each 4-gram's last symbol, interpolated down to equal shares, by plain recursion."""
    cut4 = lambda t, n: [("\0\0\0" + t + "\0")[i - n + 1 : i + 1] for i in range(3, len(t) + 4)]
    counts = {4: Counter(g for i in trusted for g in cut4(texts[i], 4))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off, total, rest = {}, defaultdict(Counter), defaultdict(Counter)
    for n, c in counts.items():
        off[n] = quality.discounts(Counter(v for v in c.values() if v < 5))
        for g, v in c.items():
            total[n][g[:-1]] += v
            rest[n][g[:-1]] += off[n][min(v, 3) - 1]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 65536
        if not (t := total[n][g[:-1]]):
            return p(g[1:])
        v = counts[n][g]
        return (v - off[n][min(v, 3) - 1] if v else 0) / t + rest[n][g[:-1]] / t * p(g[1:])

    return {i: 2 ** (-sum(np.log2(p(g)) for g in cut4(t, 4)) / (len(t) + 1)) for i, t in texts.items()}


def test_quality_is_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(quality, "BUCKET_BYTES", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").limit(60)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    trusted = [r.doc_id for r in labels.where("quality = 1").where(~quality._held_out()).collect() if r.doc_id in texts]
    want = kneser_ney(texts, trusted)
    got = {r.doc_id: r.perplexity for r in quality.report(docs, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] / want[i] - 1) for i in got) < 1e-4


def test_toxicity_finds_held_out(spark):
    """A model that always answers the same fails here, one way or the other."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.report(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    bad, good = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.9
    assert sum(s >= 0.7 for s in bad) >= 0.6 * len(bad) and sum(s >= 0.7 for s in good) <= 0.02 * len(good)


def test_personal_data_discovery(spark):
    """Secrets that text names teach their form; the same form elsewhere is found, others aren't."""
    secret = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    docs = [(i, f'some words token = "{secret(i)}" and more') for i in range(60)]
    docs += [(100 + i, f"lorem {secret(100 + i)} ipsum {i} version {i}.0") for i in range(4)]
    docs += [(200 + i, f"mail name{i}@host{i}.org x 4111 1111 1111 1111 " + "x" * 300 + f',"{secret(200 + i)}",') for i in range(4)]
    out = {r.doc_id: r for r in pii.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    found = {i: [(int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "secret"] for i, r in out.items()}
    want = {i: [(t.index(secret(i)), t.index(secret(i)) + 40)] for i, t in docs}
    assert found == want and all(out[i].n_found == 1 for i in out)
    assert out[200].n_email == 1 and out[200].n_card == 1
