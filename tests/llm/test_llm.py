"""Operators against brute force, exact round trips, SQL and held-out labels."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from oracle import same

from gaugeworks.llm import bpe, decontaminate, lines, media, neardup, pii, quality, queries, spans, toxicity, urls

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\n "), (4, "É a. b! c?\nx"), (4, "É a. b! c?\nx"), (None, "null id"), (5, "ab " * 40_000), (6, "z" * 50_000)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "xx", "node") for i, t in ODD], "doc_id long, text string, lang string, root string")


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_equals_library():
    enc = bpe.Encoder(open(P.path(queries.RANKS), "rb").read(), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "é", "漢", "1", "'s", "\x1c", "\x85", "!", "🙂", "ing", " th"]
    for text in ["", "ab" * 3000, *("".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(800))]:
        ids = enc.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)
        assert enc.decode(ids) == text.encode()


def test_bpe_query_edges(odd):
    rows = bpe.digests(odd, P.path(queries.RANKS), P.PATTERN).collect()
    assert len(rows) == len(ODD) and Counter(r.decoded_sha256 for r in rows) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)


def test_media_round_trip(odd):
    for raw in [b"", b"\xff" * 700, bytes(range(256)) * 50, b"a" * (576 * 9000)]:
        assert media.payload_of(media.decode_many([media.encode(media.pad(raw))])[0]) == media.pad(raw)
    rows = media.read_features(media.store(odd)).collect()
    assert sorted(r.payload_sha256 for r in rows) == sorted(hashlib.sha256(media.pad((t or "").encode())).hexdigest() for _, t in ODD)


def test_media_reads_other_jpeg():
    """Zero runs, end of block, codes of several lengths, no restarts."""
    dc, ac = {1: [2], 2: [0]}, {1: [0x00], 2: [0x21], 3: [0xF0]}
    bits = "0" + "11" + "10" + "1" + "0" + "10" + "0"  # DC +3; two zeros then +1; end | DC +0; end
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    data = b"\xff\xd8" + media._segment(0xDB, b"\0" + b"\x08" * 64) + media._segment(0xC0, b"\x08\0\x08\0\x10\x01\x01\x11\0")
    data += media._segment(0xC4, media._table(0, dc)) + media._segment(0xC4, media._table(0x10, ac)) + media._segment(0xDA, b"\x01\x01\0\0\x3f\0") + scan + b"\xff\xd9"
    ((w, h, c, thumb),) = media.decode_many([data])[0]
    assert (w, h) == (16, 8) and c[0, 0] == 3 and c[0, 3] == 1 and np.count_nonzero(c) == 3 and thumb.tolist() == [[131, 131]]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def hits(docs, items):
    win = defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            win[tuple(w[k : k + 10])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for s in {len(k) for k in win}:
            for k in range(len(w) - s + 1):
                if x := win.get(tuple(w[k : k + s])):
                    hit.update(range(k, k + s))
                    found |= x
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, docs, monkeypatch):
    items = [(1, "a b c"), (2, "b c"), (3, " ".join("xyzuvwabcdefgh")), (4, " ".join("zuvwabcdefghij")), (5, "a a a"), (6, ""), (7, None), (8, "q " * 12)]
    texts = [(1, "a b c a a a a"), (2, "b C"), (3, " ".join("kxyzuvwabcdefghijk")), (4, None), (5, ""), (6, "q " * 9), (7, "q " * 30), (8, "É a b")]
    t, i = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 20):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        assert {r[0]: tuple(r)[1:] for r in decontaminate.report(t, i).collect()} == hits(texts, items)
    assert decontaminate.report(t, i.limit(0)).where("contaminated").count() == 0


def test_near_duplicates(docs):
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: set(neardup.shingle_hashes(r.text.lower().split()).tolist()) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in sets:
        for j in sets:
            if j < i and (n := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {i: find(i) for i in sets}


def test_lines(docs):
    where = defaultdict(list)
    for i, t in sorted(docs.select("doc_id", "text").collect()):
        for at, x in enumerate(t.split("\n")):
            if n := lines.normal(x):
                where[n].append((i, at))
    names, index, root = list(where), defaultdict(list), {}

    def find(x):
        return x if root[x] == x else find(root[x])

    sets = [lines.shingles(n).tolist() for n in names]
    for j, s in enumerate(sets):
        root[j], shared = j, Counter()
        for g in s:
            shared.update(index[g])
            index[g].append(j)
        for k, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[k]) - n):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
    first, gone = {}, Counter()
    for j, n in enumerate(names):
        first[find(j)] = min(first.get(find(j), (1 << 60, 0)), min(where[n]))
    for j, n in enumerate(names):
        gone.update(o[0] for o in where[n] if o != first[find(j)])
    assert {r.doc_id: r.n_removed for r in lines.report(docs).collect() if r.n_removed} == dict(gone)


def test_spans(docs):
    seen, gone = defaultdict(list), defaultdict(set)
    for i, t in sorted(docs.select("doc_id", "text").collect()):
        assert "".join(spans.sentences(t)) == t
        for start, n, run in spans.runs(spans.sentences(t)):
            seen[run].append((i, start, n))
    for places in seen.values():
        for i, start, n in places[1:]:
            gone[i].update(range(start, start + n))
    assert {r.doc_id: r.n_removed for r in spans.report(docs).collect() if r.n_removed} == {i: len(s) for i, s in gone.items()}


def test_url_sql(spark):
    same(spark, queries.op1_url_filters, queries.OP1_SQL, SF)


def test_url_history(spark):
    e = [("l", "d:a.com", 10, "add"), ("l", "d:a.com", 20, "remove"), ("l", "d:a.com", 20, "add"), ("l", "d:a.com", 200, "add"), ("allow", "p:x.a.com/ok", 0, "add"), ("l", None, 1, "add")]
    c = [("http://x.a.com/ok/1", 15), ("http://x.a.com/no", 10), ("http://x.a.com/no", 20), ("http://a.com", 500), ("http://ba.com/", 15), (None, 1), ("nonsense", 15), ("http://x.a.com/no", 10)]
    out = urls.judge(spark.createDataFrame(c, "url string, day long"), spark.createDataFrame(e, "list string, key string, day long, action string"))
    got = Counter((r.url, r.day, tuple(r.lists), r.blocked) for r in out.collect())
    assert got == Counter([(c[0][0], 15, ("allow", "l"), False), (c[1][0], 10, ("l",), True), (c[1][0], 20, (), False), (c[3][0], 500, ("l",), True), (c[4][0], 15, (), False), (None, 1, (), False), ("nonsense", 15, (), False), (c[1][0], 10, ("l",), True)])


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, (name, p) in enumerate(KINDS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if not (name == "ip" and any(int(x) > 255 for x in m[0].split(".")) or name == "card" and not (12 <= len(d) <= 19 and luhn(d)) or name == "phone" and not 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


def test_personal_data(spark):
    texts = ["a@b.com_x@c.de", "1.2.3.4.5.6.7.8 999.1.1.1", "4111 1111 1111 1111 + +1 (743) 555-3824", "é🙂 x@y.zz, 10.0.0.1", "0" * 30000, "a" * 100000, "+" * 5000 + "1" * 20000, "a.b@c-.d..e@f.g.h", None, ""]
    out = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.base_sha256 for r in out} == {i: hashlib.sha256(base(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_personal_data_unseen(spark):
    """A pattern that seeds teach finds an identifier that no base pattern fits."""
    known = [f"reach dialnow +1-555-0{i:03d}-12 today" for i in range(40)]
    out = pii.report(spark.createDataFrame([*enumerate(known), (99, "reach dialnow +1-55-12-1 today")], "doc_id long, text string"))
    assert out.where("doc_id = 99").first().spans == "phone:14:24"


def test_toxicity_held_out(spark):
    out = toxicity.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels := spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    held = out.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted and not r.toxic for r in held) <= 0.02 * len(held)


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.report(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r.millibits for r in rows if r.quality == 1], [r.millibits for r in rows if r.quality == 0]
    assert np.mean([b > g for b in bad for g in good]) > 0.8
    assert sum(not r.keep for r in rows if r.quality == 1) <= 0.02 * len(good) + 1
    assert quality.report(docs, labels.limit(0)).where("not keep").count() == 0


@pytest.mark.parametrize("f", [spans.report, lines.report, neardup.classes, pii.report])
def test_odd_rows(odd, f):
    assert f(odd).count() == len(ODD)
    assert f(odd.limit(0)).count() == 0


def _same_band_components(keys, alike):
    root = list(range(len(keys)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(keys)):
        for j in range(i):
            if (keys[i] == keys[j]).any() and alike(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {frozenset(j for j in range(len(keys)) if find(j) == r) for r in {find(i) for i in range(len(keys))}}


def _groups(at, roots):
    """Sets of texts of one root; ``roots`` by id, texts without one are alone."""
    groups = defaultdict(set)
    for k, i in at.items():
        groups[roots.get(k, k)].add(i)
    return set(map(frozenset, groups.values()))


@pytest.mark.parametrize("block", [None, 3000])
def test_lines_of_one_template(spark, monkeypatch, block):
    """Bands of many different lines: pairs that no centre meets are joined."""
    if block:
        monkeypatch.setattr("gaugeworks.llm.common.BLOCK", block)
        monkeypatch.setattr("gaugeworks.llm.common.LOCAL", 40)
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    head, texts = draw(86), []
    for _ in range(150):
        slot = draw(6)
        texts += [head + slot, head + slot[:4] + draw(2)]
    texts = sorted(set(texts))
    want = _same_band_components(lines.band_keys(lines.signatures(texts)), lambda i, j: lines.jaccard(texts[i], texts[j]) >= 0.9)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(4)
    plain = docs.selectExpr("doc_id AS ord", "doc_id AS r", "doc_id AS q", "text")
    got = _groups({int(k): i for i, k in enumerate(lines.line_ids(texts)[0])}, {r.node: r.root for r in lines.links(plain, 0.9)[0].collect()})
    assert 1 < len(want) and got == want


@pytest.mark.parametrize("block", [None, 20_000])
def test_near_duplicates_of_one_boilerplate(spark, monkeypatch, block):
    """Bands of many different texts: pairs that no centre meets are joined."""
    if block:
        monkeypatch.setattr("gaugeworks.llm.common.BLOCK", block)
        monkeypatch.setattr("gaugeworks.llm.common.LOCAL", 40)
    rng = random.Random(9)
    draw = lambda n: [str(rng.random()) for _ in range(n)]
    head, texts = draw(90), []
    for _ in range(150):
        tail = draw(14)
        texts += [head + tail, head + tail[:8] + draw(6)]
    sets = [np.unique(neardup.shingle_hashes(x)) for x in texts]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    keys = neardup.band_keys(neardup.prob_min_hash(np.concatenate(sets), np.ones(len(owner)), owner, len(sets)))
    want = _same_band_components(keys, lambda i, j: neardup.similar(sets[i].tobytes(), sets[j].tobytes()) >= 0.85)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").repartition(4)
    prints = neardup.common.cut(neardup.fingerprints(docs))
    got = _groups({neardup.key_of(x)[0]: i for i, x in enumerate(texts)}, {r.k: r.root for r in neardup.links(docs, prints, 0.85).collect()})
    assert 1 < len(want) and got == want


def test_spans_of_repeated_rows(spark):
    """Rows of equal doc_id and text are one document: its sentences stay, and go from later documents."""
    text = " ".join(f"Sentence {i} of this text has quite a few words to fill a run." for i in range(6))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text.upper() + " x"), (None, text.upper() + " x"), (7, text)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.n_sentences, r.n_removed) for r in spans.report(docs.repartition(3)).collect())
    assert out == [(0, 7, 0), (0, 7, 0), (1, 6, 6), (1, 6, 6), (7, 6, 6)]
    out = spans.report(docs.where("doc_id = 1")).collect()
    assert [r.text for r in out] == [text, text]


def test_toxicity_shared_opening(spark):
    """Labelled texts that begin alike are counted one by one."""
    head = "this page was sent by the forum and all of its pages have one and the same opening line "
    docs = spark.createDataFrame([(i, f"{head} {'zorgle' if i % 2 else 'fine'} number {i}") for i in range(120)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    assert "zorgle" in toxicity.fit(docs, labels)["lexicon"]
    scores = {r.doc_id: r.score for r in toxicity.report(docs, labels).collect()}
    assert min(scores[i] for i in scores if i % 2) > max(scores[i] for i in scores if i % 2 == 0)
