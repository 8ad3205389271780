"""Secret scans: base spans against brute force, the battery's calibration, planted secrets against look-alikes."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from gaugeworks.llm import queries, secrets

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+"),
}
TESTS = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}


def base(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if TESTS[kind](m)]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans)]


def same_base(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        kept = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert kept == want and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
        assert r.n_found == r.spans.count("random:")


def test_query_keeps_base_spans(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_secret_scans(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    same_base(rows, texts)


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(6)
    parts = ["token", "Secret", "PASSWD", "api_key", "apikey", "password", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCD1234EFGH", "deadbeef", "0123456789abcdef", "é", "漢", "🙂", ".", "-", "/", "\n", "x", "Kk"]
    texts = {i: "".join(rng.choices(parts, k=rng.randint(0, 40))) for i in range(400)}
    texts |= {1000: None, 1001: "", 1002: " \n ", 1003: "token=" + "a" * 100_000, 1004: "token" + " " * 50_000 + "= abcdefgh12", 1005: "f" * 120_000, 1006: 'token: secret "abcdefgh12"'}
    rows = [(i, t, "k", 1) for i, t in texts.items()] + [(1003, texts[1003], "k", 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, r int")
    got = secrets.report(docs).collect()
    assert len(got) == len(rows)
    same_base(got, texts)
    assert secrets.report(docs.limit(0)).count() == 0 and secrets.find(docs.limit(0)).count() == 0
    spans = {(r.doc_id, r.kind, r.start, r.end) for r in secrets.find(docs).collect()}
    assert spans == {(r.doc_id, s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2])) for r in got for s in r.spans.split(",") if s}


def plain_fit(token, code):
    """The four tests by plain loops."""
    alphabet = secrets.ENCODINGS[code][1]
    n, a, v = len(token), len(alphabet), [alphabet.index(c) + 1 for c in token]
    x = a / n * sum(v.count(k) ** 2 for k in range(1, a + 1)) - n
    z1 = (x - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n)
    kind = lambda c: "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o"
    kinds = {k: sum(kind(c) == k for c in alphabet) / a for k in {kind(c) for c in alphabet}}
    y, df = sum((sum(kind(c) == k for c in token) - n * p) ** 2 / (n * p) for k, p in kinds.items()), len(kinds) - 1
    z2 = ((y / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [k > a // 2 for k in v]
    m, runs = sum(high), 1 + sum(p != q for p, q in zip(high, high[1:]))
    due = 2 * m * (n - m) / n + 1
    spread = (due - 1) * (due - 2) / (n - 1)
    z3 = abs(runs - due) / math.sqrt(spread) if spread > 0 else 9
    d = np.array(v) - np.mean(v)
    z4 = abs((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n) if (d * d).sum() > 1e-9 else 9
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    h = -sum(math.log(max(p, 1e-300)) for p in (tail(z1), tail(z2), 2 * tail(z3), 2 * tail(z4)))
    return math.exp(-h) * (1 + h + h * h / 2 + h**3 / 6)


@pytest.fixture(scope="module")
def random_tokens():
    rng = random.Random(2)
    return [("".join(rng.choices(a, k=n)), code) for code, (_, a) in secrets.ENCODINGS.items() for n in (16, 24, 40, 90) for _ in range(100)]


def test_battery_equals_loops_and_is_even_on_random_tokens(spark, random_tokens):
    extra = [("a" * 40, "base36"), ("ab" * 20, "hex"), ("Zz9" * 9, "base62")]
    rows = secrets.fit(spark.createDataFrame(random_tokens + extra, "token string, code string")).collect()
    for r in rows:
        assert r.fit == pytest.approx(plain_fit(r.token, r.code), abs=1e-5)
    fits = np.array([r.fit for r in rows][: len(random_tokens)])
    assert 0.4 < fits.mean() < 0.6 and (fits < 0.01).mean() < 0.06 and (fits > 0.9).mean() > 0.05


def test_finds_planted_secrets_among_lookalikes(spark):
    rng = random.Random(9)
    words = [w for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(60).collect() for w in re.findall("[A-Za-z]{3,}", r.text)]
    prose = lambda k: " ".join(rng.choices(words, k=k))

    def lookalike():
        w = [x.lower() for x in rng.choices(words, k=6)]
        return rng.choice(["".join(x.title() for x in w) + "2", "-".join(w) + "-2024", f"2024/05/{w[0]}/{w[1]}{w[2]}", f"{w[0]}{w[1]}12{w[2]}{w[3]}14", "_".join(w) + "_v3", "abc123" * 4, "AAAA1111BBBB2222CCCC"])

    plan = [("base62", 40), ("base64", 44), ("base64url", 48), ("HEX", 40), ("base32", 40), ("base36", 40), ("hex", 30)]
    rows, planted = [], {}
    for i in range(1400):
        code, n = plan[i % len(plan)]
        key = "".join(rng.choices(secrets.ENCODINGS[code][1], k=n)) if i % 2 else lookalike()
        head = prose(rng.randint(40, 90)) + " is "
        rows.append((i, f"{head}{key} and {prose(60)}"))
        if i % 2:
            planted[i] = (len(head), len(head) + n, code)
    got = secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'random'").collect()
    assert len({tuple(r) for r in got}) == len(got)
    right = [r for r in got if r.doc_id in planted and (r.start, r.end) == planted[r.doc_id][:2]]
    found = {code: sum(planted[r.doc_id][2] == code for r in right) / sum(p[2] == code for p in planted.values()) for code, _ in plan}
    assert len(right) / len(got) >= 0.9 and len(right) / len(planted) >= 0.85 and min(found.values()) >= 0.5, found


def test_few_decoys_add_nothing(spark):
    docs = spark.createDataFrame([(1, "the key xQ7bWz0PmL4tYc9RkV2nGd8Hs is here")], "doc_id long, text string")
    assert secrets.report(docs).first().n_found == 0


def test_no_python_in_plan(spark):
    docs = spark.createDataFrame([(1, "token = abcdefgh12")], "doc_id long, text string")
    plan = secrets.report(docs)._jdf.queryExecution().toString()
    assert not re.search("EvalPython|InArrow|InPandas|PythonUDF", plan)
