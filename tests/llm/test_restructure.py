"""Fill-in-the-middle and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from oracle import same

from gaugeworks.llm import chats, fim, queries

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_conversation_repair"])
def test_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_checkpoints_find_every_cut(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(fim, "CHUNK", 17)
    for _ in range(400):
        text = "".join(rng.choices(["a", "é", " ", "\n", "漢", "🙂", "b", "\x0b"], k=rng.randint(0, 80)))
        units = UNIT.findall(text)
        found = fim.Checkpoints(text.encode(), step=rng.choice([1, 2, 3, 7]))
        assert (found.units, found.points) == (len(units), len(text))
        for n in range(len(units) + 1):
            head = "".join(units[:n])
            assert found.cut(n) == (len(head.encode()), len(head))


def test_fill_in_middle_edges(spark):
    """Nulls, empty and long texts, sentinels in and across the cuts, repeated rows, other columns of the same names."""
    texts = [None, "", " \n ", "a", "a <S> b c", "<<P> x", "é 漢字 🙂 " * 20_000, "z" * 300_000, "< < < S> P> M> <P <S <M > > >"]
    rows = [(i, t, f"o{i}", i, "x") for i, t in enumerate(texts * 12)] + [(None, "some words here", "o", 0, "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n long, FORM string")
    out = fim.transform(docs)
    assert out.columns == [*docs.columns, "n_", "form_", "prefix_chars", "middle_chars", "output_"]
    got = fim.restore(out, "output_", "form_").collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        assert r.restored == text and r.n_ == len(UNIT.findall(text)) and r.output == ("o" if r.doc_id is None else f"o{r.doc_id}")
        h = hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
        plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50
        assert r.form_ == ("plain" if plain else "spm" if h[3] % 100 < 80 else "psm")
        if plain:
            assert (r.output_, r.prefix_chars, r.middle_chars) == (text, None, None)
            continue
        units, (a, b) = UNIT.findall(text), sorted(x % (r.n_ + 1) for x in h[:2])
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        assert (r.prefix_chars, r.middle_chars) == (len(p), len(m))
        assert r.output_ == (f"<S>{s}<P>{p}<M>{m}" if r.form_ == "spm" else f"<P>{p}<S>{s}<M>{m}")
    assert {r.form_ for r in got} == {"plain", "psm", "spm"}
    assert fim.report(docs.limit(0)).count() == 0


def brute(codes):
    """Cheapest edits from the end, for any code string."""

    @cache
    def best(i, state, more=0):
        out = [(0, "")] if i == len(codes) and state in (0, 3) else []
        step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
        to = 3 if state == 2 else 2
        if i < len(codes):
            initial, fault = "sua-"[codes[i] // 3], codes[i] % 3
            out.append((3, "D", *best(i + 1, state)))
            if fault < 2:
                out.append((2 + fault, "R", *best(i + 1, to)))
                if initial in step:
                    out.append((fault, "K", *best(i + 1, step[initial])))
        if more < 3:
            out.append((2, "I", *best(i, to, more + 1)))
        return min(((x[0], x[1]) if len(x) == 2 else (x[0] + x[2], x[1] + x[3]) for x in out), default=(10**9, ""))

    return best(0, 0)


def test_search_chain_and_pieces_equal_brute_force(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(chats, "STRETCH", 4)
    for _ in range(1500):
        pool = rng.choice([range(12), [9, 9, 9, 3, 6], [3, 6, 3, 6, 9, 4]])
        codes = bytes(rng.choices(list(pool), k=rng.randint(0, 14)))
        want = brute(codes)
        assert list(chats.search(codes, 0, True).values()) == [want] == [chats.finish(chats.chain(codes, 0))]
        a, b = sorted(rng.randint(0, len(codes)) for _ in range(2))
        parts = [x for x in (codes[:a], codes[a:b], codes[b:]) if x]
        assert chats.follow([{e: chats.chain(x, e) for e in range(4)} for x in parts]) == want


def test_chain_is_linear():
    codes = bytes([9, 3, 4, 6, 7] * 40_000)
    cost, edits = chats.finish(chats.chain(codes, 0))
    assert cost > 0 and len(edits.replace("I", "")) == len(codes)


def expected(rows):
    """Report of (conv_id, turn, role, text) rows by plain loops."""
    convs, out = {}, {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        kept += [(turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults = set(), []
        for _, role, text in kept:
            inked = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not inked else "duplicate" if (role, text) in seen else "" if inked[-1] in ".!?" else "truncated")
            seen.add((role, text))
        codes = bytes("sua-".index(r[1][:1] if r[1][:1] and r[1][:1] in "sua" else "-") * 3 + {"": 0, "truncated": 1}.get(f, 2) for r, f in zip(kept, faults, strict=True))
        cost, audit = brute(codes) if len(codes) < 400 else chats.finish(chats.chain(codes, 0))
        turns = [r[0] for r in kept if r[0] is not None]
        repaired, at = [], iter(kept)
        for e in audit:
            due = "assistant" if repaired and repaired[-1].startswith("u") else "user"
            if e == "I":
                repaired.append(f"{due}:")
                continue
            _, role, text = next(at)
            if e != "D":
                repaired.append(f"{due if e == 'R' else role}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def test_conversation_edges(spark):
    """Nulls in every column, odd roles, repeated rows, ties, gaps, an unbounded conversation over many tasks, clashing names."""
    rng = random.Random(8)
    roles, ends = ["system", "user", "assistant", "tool", "", None, "u"], ["fine.", "cut off", "", " \n", None, "why?  ", "same.", "x" * 5000]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(ends)) for c in [None, *range(60)] for _ in range(rng.randint(1, 7))]
    case = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    rows = list({(c, t, "user" if case(c, t) == 4 else r): (c, t, r, x) for c, t, r, x in rows}.values())  # one text for each turn and damaged role, as ties beyond these go by a digest
    rows += rng.sample(rows, 40)
    rows += [(77, t, rng.choice(roles[:3]), rng.choice(["again.", f"row {t}.", f"row {t}"])) for t in range(3000)]
    data = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, n long, piece string")
    got = {r.conv_id: tuple(r)[1:] for r in chats.report(data).collect()}
    assert got == expected(rows)
    assert chats.report(data.limit(0)).count() == 0


def test_repaired_rows_have_the_form(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "cut"), (2, 0, "assistant", " "), (3, 0, "system", "Be kind."), (3, 1, "assistant", "Well.")]
    got = chats.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "at").collect()
    assert [(r.conv_id, r.at, r.role, r.text) for r in got] == [(1, 0, "user", "Hi."), (1, 1, "assistant", "cut"), (3, 0, "system", "Be kind."), (3, 1, "user", ""), (3, 2, "assistant", "Well.")]
