"""The five stages against brute force on a small table."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken

from gaugeworks.llm import bpe, lines, neardup, queries
from test_edges import kneser_ney, quality
from test_llm import WORD, low

LANGS, QUANTILE, SHRINK = ("en", "de"), 0.999, 100


def classes(keys, alike):
    root = {k: k for k in keys}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if alike(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def brute(docs, labels, items):
    texts = {i: t or "" for i, t, _ in docs}
    good = [r.doc_id for r in labels if r.quality == 1 and r.doc_id in texts]
    held = {r.doc_id for r in labels if r.held}
    ppl = kneser_ney(texts, [i for i in good if i not in held])
    n = {i: len(texts[i]) + 1 for i in texts}
    bits = {i: np.log2(ppl[i]) * n[i] for i in texts}
    at = lambda xs, q: sorted(xs)[int(np.ceil(len(xs) * q)) - 1]
    test = [(i, lang) for i, _, lang in docs if i in held and i in good]
    median = {x: at([np.floor(bits[i] / n[i] * 1000) for i, lang in test if x in (lang, "*")], 0.5) for x in {y for _, y in test} | {"*"}}
    rate = lambda i, lang: np.floor((bits[i] * 1000 + median.get(lang, median["*"]) * SHRINK) / (n[i] + SHRINK))
    shrunk = [(np.floor((bits[i] * 1000 + median[lang] * SHRINK) / (n[i] + SHRINK)), lang) for i, lang in test]
    limit = {x: at([v for v, lang in shrunk if x in (lang, "*")], QUANTILE) for x in median}
    kept = {i: t for i, t, lang in docs if rate(i, lang) <= limit.get(lang, limit["*"])}
    # lines
    where = {}
    for i in sorted(kept):
        for k, x in enumerate((kept[i] or "").split("\n")):
            if w := lines.normal(x):
                where.setdefault(w, []).append((i, k))
    names = sorted(where)
    shingles = {w: set(lines.shingles(w).tolist()) for w in names}
    alike = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    group = classes(names, alike)
    first = {}
    for w in names:
        first[group[w]] = min(first.get(group[w], (1 << 60, 0)), where[w][0])
    gone = {o for w in names for o in where[w] if o != first[group[w]]}
    kept = {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in kept.items()}
    # documents
    sets = {}
    for i, t in kept.items():
        w = (t or "").lower().split()
        sets[i] = set(neardup.shingle_hashes(w).tolist()) if w else {"none"}
    group = classes(sorted(kept), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = {i: t for i, t in kept.items() if group[i] == i}
    # benchmark
    wins = {}
    for t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])] = 1
    out = {}
    for i, t in kept.items():
        found = list(WORD.finditer(low(t)))
        hit = set()
        for size in {len(k) for k in wins}:
            for k in range(len(found) - size + 1):
                if tuple(m[0] for m in found[k : k + size]) in wins:
                    hit.update(range(k, k + size))
        if len(hit) * 2 > len(found):
            continue
        left, at_ = [], 0
        for k in sorted(hit):
            if k - 1 not in hit:
                left.append((t or "")[at_ : found[k].start()])
            at_ = found[k].end()
        out[i] = "".join(left) + (t or "")[at_:]
    return out


def test_pipeline(spark, tmp_path):
    src = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{src}/documents.parquet").where("length(text) < 2500 and doc_id % 3 = 0")
    base = [(r.doc_id, r.text, r.lang) for r in docs.orderBy("doc_id").limit(110).collect()]
    item = " ".join(f"bench{i} word" for i in range(12))
    more = [(9000, None, "en"), (9001, "", "en"), (9002, base[0][1], base[0][2]), (9003, base[1][1] + f"\nthe end of it: {item} and so on with some more words behind it to keep the document", base[1][2]), (9004, item, "en"), (9005, base[2][1] + "\n" + base[3][1], base[2][2])]
    rows = base + more
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{src}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items = [item, "", None, "one two"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(rows, labels.withColumn("held", quality._held_out()).collect(), items)
    ranks = bpe.Encoder(open(P.path(queries.RANKS), "rb").read(), P.PATTERN).ranks
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 50 < len(want) < len(rows) and got.keys() == want.keys()
    for i, t in want.items():
        assert got[i] == (np.array(lib.encode_ordinary(t), "<u4").tobytes(), hashlib.sha256(t.encode()).hexdigest())
