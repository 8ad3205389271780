import itertools
import random
import tracemalloc

import pytest

from gaugeworks.operators import text


def test_rouge_literals(spark):
    rows = [(1, "Mary loves Joe", ["Mary loves Jane"]), (2, "", ["a b"]), (3, None, []), (4, "a a b", ["x", "A, b!"])]
    out = text.rouge(spark.createDataFrame(rows, "uid long, prediction string, references array<string>"))
    got = {(r.uid, r.rouge_type): round(r.value, 9) for r in out.collect()}
    assert got == {(1, "rouge1"): round(2 / 3, 9), (1, "rouge2"): 0.5, (2, "rouge1"): 0, (2, "rouge2"): 0, (3, "rouge1"): 0, (3, "rouge2"): 0, (4, "rouge1"): 0.8, (4, "rouge2"): round(2 / 3, 9)}


@pytest.mark.parametrize(("weights", "want"), [((1,), 2 / 3), ((0, 1), 0.5), ((0, 0, 1), 0), ((0.25,) * 4, 0)])
def test_bleu_literals(spark, weights, want):
    rows = [(1, "Mary loves Joe", ["Mary loves Jane"]), (2, "MARY LOVES JOE", ["Mary loves Joe"]), (3, None, None), (4, "a b", []), (5, "", ["a"])]
    got = {r.uid: r.value for r in text.bleu(spark.createDataFrame(rows, "uid long, prediction string, references array<string>"), weights).collect()}
    assert got == pytest.approx({1: want, 2: 0, 3: 0, 4: 0, 5: 0})


def test_bleu_penalty(spark):
    """Of references equally near the shorter counts; short predictions pay."""
    rows = [(1, "a b c", ["a b", "a b c d"]), (2, "a b", ["a b c d"])]
    got = {r.uid: r.value for r in text.bleu(spark.createDataFrame(rows, "uid long, prediction string, references array<string>"), [1]).collect()}
    assert got == pytest.approx({1: 1.0, 2: 2.718281828459045**-1})
    with pytest.raises(ValueError):
        text.bleu(spark.range(1), [])


def test_rouge_sequences(spark):
    rows = [(1, "Mary loves Joe", ["Mary loves Jane"]), (2, None, ["x"]), (3, "a", None), (4, "c d\na b", ["a b\nc d", "z"])]
    got = {(r.uid, r.rouge_type): r.value for r in text.rouge_sequences(spark.createDataFrame(rows, "uid long, prediction string, references array<string>")).collect()}
    want = {(1, "rougeL"): 2 / 3, (1, "rougeLsum"): 2 / 3, (4, "rougeL"): 0.5, (4, "rougeLsum"): 1.0}
    assert got == pytest.approx({**{(i, k): 0.0 for i in (2, 3) for k in ("rougeL", "rougeLsum")}, **want})


def test_common_subsequence_brute():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 7))] for _ in range(2))
        subs = {c for n in range(len(b) + 1) for c in itertools.combinations(b, n)}
        best = max(n for n in range(len(a) + 1) if any(c in subs for c in itertools.combinations(a, n)))
        places = sorted(text.common_places(a, b))
        assert text.common_length(a, b) == best == len(places) and tuple(a[i] for i in places) in subs


def grid_places(a, b):
    """By the whole table of lengths."""
    grid = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(grid[-1][j] + 1 if x == y else max(grid[-1][j + 1], row[j]))
        grid.append(row)
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif grid[i][j - 1] > grid[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def test_places_take_the_way_of_the_whole_table():
    rnd = random.Random(8)
    for _ in range(600):
        a, b = ([rnd.choice("abcdefg"[: rnd.randint(1, 7)]) for _ in range(rnd.randint(0, 60))] for _ in range(2))
        assert text.common_places(a, b) == grid_places(a, b)


def test_long_lines_need_little_memory():
    rnd = random.Random(9)
    a, b = ([rnd.choice("abcdefghij") for _ in range(20_000)] for _ in range(2))
    tracemalloc.start()
    places = text.common_places(a, b)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    assert len(places) == text.common_length(a, b)


def test_stems_in_sequences(spark):
    rows = [(1, "flipping the roaring dolphins\nsecond line", ["flip the roar dolphin\nlines second"]), (1, "flipping", ["flips"])]
    data = spark.createDataFrame(rows, "uid long, prediction string, references array<string>")
    got = sorted((r.rouge_type, r.value) for r in text.rouge_sequences(data, use_stemmer=True).collect())
    assert got == [("rougeL", pytest.approx(10 / 12)), ("rougeL", 1.0), ("rougeLsum", pytest.approx(10 / 12)), ("rougeLsum", 1.0)]
    assert {r.value for r in text.rouge_sequences(data).collect()} != {r.value for r in text.rouge_sequences(data, True).collect()}
    assert sorted((r.rouge_type, r.value) for r in text.rouge(data, use_stemmer=True).collect())[-1] == ("rouge2", pytest.approx(0.6))


def test_uids_given_twice_stay_apart(spark):
    rows = [(1, "a b", ["a b"]), (1, "c d", ["a b"]), (2, "x", None), (2, None, [])]
    data = spark.createDataFrame(rows, "uid long, prediction string, references array<string>")
    assert sorted((r.uid, r.value) for r in text.bleu(data, [1]).collect()) == [(1, 0.0), (1, 1.0), (2, 0.0), (2, 0.0)]
    assert sorted((r.uid, r.value) for r in text.rouge(data, (1,)).collect()) == [(1, 0.0), (1, 1.0), (2, 0.0), (2, 0.0)]


def test_grams_are_counted_inside_a_row(spark):
    """No task holds n-grams of many rows: nothing is shuffled; frequent n-grams are clipped, short and null texts give 0."""
    rows = [(1, "a b a b a b", ["a b", "b a b a", None]), (2, None, ["x"]), (3, "x", None), (4, "x y", [])]
    data = spark.createDataFrame(rows, "uid long, prediction string, references array<string>")
    for out in (text.rouge(data), text.bleu(data, (0.5, 0.5))):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    found = {(r.uid, r.rouge_type): r.value for r in text.rouge(data).collect()}
    assert found == {(1, "rouge1"): pytest.approx(0.8), (1, "rouge2"): pytest.approx(0.75)} | {(k, f"rouge{n}"): 0.0 for k in (2, 3, 4) for n in (1, 2)}
    assert {r.uid: r.value for r in text.bleu(data, (0.5, 0.5)).collect()} == {1: pytest.approx((4 / 6 * 3 / 5) ** 0.5), 2: 0.0, 3: 0.0, 4: 0.0}
