"""Judge calls once for a whole table: equal prompts, retries, runs that break off, all twelve scores."""

import json
import random
from collections import Counter

import pytest

from gaugeworks import metrics
from gaugeworks.operators import judged, text
from gaugeworks.plans.stand_in import RuleClient

SCHEMA = "uid string, query string, response string, groundtruths array<string>, contexts array<string>"


def counting(folder, fail_at=None, wrong=0):
    """Clients that note each prompt in a file, fail once ``fail_at`` are noted, and break the format of the first ``wrong`` tries."""

    def make():
        rules = RuleClient()

        def client(messages):
            prompt = messages[-1]["content"]
            seen = [json.loads(x) for f in folder.iterdir() for x in f.read_text().splitlines()]
            if fail_at is not None and len(seen) >= fail_at:
                raise RuntimeError("the service is down")
            with (folder / str(id(client))).open("a") as f:
                f.write(json.dumps(prompt) + "\n")
            return "no reply" if seen.count(prompt) < wrong else rules(messages)

        client.model_name = "counted"
        return client

    return make


def noted(folder):
    return Counter(json.loads(x) for f in folder.iterdir() for x in f.read_text().splitlines())


@pytest.fixture
def rows(spark):
    data = [(str(i), f"what is {i % 3}", f"It is so {i % 4}. And more", ["A truth. Two", "Other"][: i % 3], [f"ctx {i % 2}", "more ctx"][: 1 + i % 2]) for i in range(24)]
    return spark.createDataFrame([*data, ("x", None, None, None, None), ("x", None, None, None, None)], SCHEMA).repartition(6)


def test_each_prompt_is_asked_once(spark, rows, tmp_path):
    (tmp_path / "notes").mkdir()
    got = sorted(map(repr, judged.judge(rows, counting(tmp_path / "notes"), store=f"{tmp_path}/replies").collect()))
    asked = noted(tmp_path / "notes")
    assert asked and set(asked.values()) == {1}
    again = sorted(map(repr, judged.judge(rows, counting(tmp_path / "notes"), store=f"{tmp_path}/replies").collect()))
    assert again == got and noted(tmp_path / "notes") == asked
    judged.judge(rows, counting(tmp_path / "notes"), system_prompt="Other", metrics=["bias"], store=f"{tmp_path}/replies").collect()
    assert noted(tmp_path / "notes") != asked  # another system prompt, other replies
    assert sum(r.uid == "x" for r in judged.judge(rows, RuleClient, ["bias"]).collect()) == 2


def test_a_run_that_breaks_off_goes_on(spark, rows, tmp_path):
    """What ended before the failure isn't asked again."""
    (tmp_path / "notes").mkdir()
    with pytest.raises(Exception, match="service is down"):
        judged.judge(rows, counting(tmp_path / "notes", fail_at=20), store=f"{tmp_path}/replies", per_task=2).collect()
    got = judged.judge(rows, counting(tmp_path / "notes"), store=f"{tmp_path}/replies", per_task=2)
    plain = judged.judge(rows, RuleClient)
    drop = lambda f: sorted((r.uid, r.type, r.value) for r in f.collect())
    assert drop(got) == drop(plain)
    asked = noted(tmp_path / "notes")
    assert asked.total() - len(asked) <= 2 * 4 and max(asked.values()) <= 2  # tasks that were on their way


def test_retries_ask_anew(spark, rows, tmp_path):
    (tmp_path / "notes").mkdir()
    few = rows.where("uid < '2'")
    got = judged.judge(few, counting(tmp_path / "notes", wrong=1), ["context_relevance", "summary_coherence"], retries=1).collect()
    assert all(r.error is None for r in got) and set(noted(tmp_path / "notes").values()) == {2}
    (tmp_path / "more").mkdir()
    got = judged.judge(few, counting(tmp_path / "more", wrong=5), ["summary_coherence"], retries=1).collect()
    assert got and all(r.error and r.value is None for r in got) and set(noted(tmp_path / "more").values()) == {2}


def test_texts_move_once(spark, tmp_path):
    """What is shuffled and written follows the prompts, which are ten times the texts; rows don't move again for each score."""
    rng = random.Random(5)
    text_of = lambda: ". ".join(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(12)) for _ in range(20))
    data = [(str(i), q, text_of(), [q], q.split(". ")) for i, q in enumerate(text_of() for _ in range(200))]
    size = sum(len(q) + len(r) for _, q, r, *_ in data)
    frame = spark.createDataFrame(data, SCHEMA).repartition(4)
    driver = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver")
    before = driver().totalShuffleWrite()
    got = judged.judge(frame, RuleClient, store=f"{tmp_path}/replies", per_task=500)
    assert got.count() == 2000 and got.where("value is null").isEmpty()
    assert driver().totalShuffleWrite() - before < 20 * size


def test_two_replies_to_a_prompt(spark, rows, tmp_path):
    """What a killed task left besides the reply of its other try: the same one counts for all rows, once, and nothing is asked."""
    (tmp_path / "notes").mkdir()
    first = judged.judge(rows, counting(tmp_path / "notes"), store=f"{tmp_path}/replies").collect()
    asked = noted(tmp_path / "notes")
    more = [(r.asked, r.attempt, "I say 1.") for r in spark.read.parquet(f"{tmp_path}/replies").collect() if r.reply.startswith("I say")]
    spark.createDataFrame(more, "asked string, attempt int, reply string").write.mode("append").parquet(f"{tmp_path}/replies")
    again = judged.judge(rows, counting(tmp_path / "notes"), store=f"{tmp_path}/replies").collect()
    want = sorted((repr(r.uid), r.type, 1.0 if r.type == "summary_coherence" else r.value) for r in first)
    assert sorted((repr(r.uid), r.type, r.value) for r in again) == want and noted(tmp_path / "notes") == asked


def test_all_twelve_scores(spark, rows):
    done = judged.TextEvaluator(RuleClient).compute_all(rows.where("uid = '5'"), use_stemmer=True)
    kinds = Counter(m.type for m in done["5"])
    assert kinds == {**{k: 1 for k in ("AnswerCorrectness", "AnswerRelevance", "Bias", "ContextPrecision", "ContextRecall", "ContextRelevance", "Faithfulness", "Hallucination", "SummaryCoherence", "Toxicity", "BLEU")}, "ROUGE": 4}
    rouge = {m.parameters["rouge_type"]: m.value for m in done["5"] if m.type == "ROUGE"}
    own = rows.where("uid = '5'").selectExpr("uid", "response AS prediction", "groundtruths AS references")
    want = {r.rouge_type: r.value for r in text.rouge(own, use_stemmer=True).union(text.rouge_sequences(own, True)).collect()}
    assert rouge == want and all(m.parameters["use_stemmer"] for m in done["5"] if m.type == "ROUGE")
    assert next(m for m in done["5"] if m.type == "BLEU").parameters == {"weights": [0.25] * 4}
    assert Counter(r.type for r in judged.compute_all(rows.where("uid = 'x'"), RuleClient, ["rouge1"]).collect())["rouge1"] == 0
    with pytest.raises(ValueError):
        judged.compute_all(rows, RuleClient, ["rouge9"])


def test_clients_by_name():
    assert judged.TextEvaluator.openai(retries=2).options["retries"] == 2 and judged.TextEvaluator.mistral().options["store"] is None
    with pytest.raises(ValueError):
        judged.TextEvaluator.openai(seed=1, retries=1)


def test_metric_of_errors(spark):
    frame = spark.createDataFrame([("1", "bias", None, "m", 0, "broken")], judged.SCHEMA)
    (m,) = metrics.judged(frame)["1"]
    assert m.type == "Error" and m.value["message"] == "broken"
