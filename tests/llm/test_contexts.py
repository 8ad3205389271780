"""Personal data that no base pattern matches, found by contexts that the seeds teach."""

import random

from gaugeworks.llm import pii


def test_contexts_reach_unseen_identifiers_of_several_kinds(spark):
    rng = random.Random(7)
    filler = ["river", "stone", "light", "green", "quiet", "morning", "paper", "window"]
    prose = lambda k: " ".join(rng.choices(filler, k=k))
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    mixed = lambda k: "".join(rng.choices("abcdef0123456789", k=k - 2)) + "a1"
    seeds = {
        "email": lambda: f"contact ann{digits(3)}@host{digits(1)}.org", "phone": lambda: f"dial +1 ({digits(3)}) {digits(3)}-{digits(4)}",
        "ip": lambda: f"server 10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", "secret": lambda: f'passkey = "{mixed(40)}"',
    }
    unseen = {
        "email": lambda: ("contact ", f"bob{digits(3)}@intranet"), "phone": lambda: ("dial ", f"{digits(3)} {digits(3)} {digits(4)}"),
        "ip": lambda: ("server ", f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(300, 900)}" if rng.random() < 0.5 else f"192.168.{digits(3)}"), "secret": lambda: ("passkey: ", mixed(24)),
    }
    others = [lambda: f"chapter {digits(2)}", lambda: f"room {digits(3)}", lambda: f"version {digits(1)}.{digits(1)}", lambda: f"in {digits(4)}", lambda: f"@home{digits(1)}", lambda: f"model x{digits(2)}b", lambda: f"order {digits(2)}-{digits(2)}"]
    docs, planted = [], set()
    for i in range(400):
        kind = rng.choice(list(seeds))
        docs.append((i, f"{prose(4)} {seeds[kind]()} {prose(3)} {rng.choice(others)()} {prose(2)}"))
    for i in range(400, 480):
        kind = list(unseen)[i % 4]
        cue, value = unseen[kind]()
        head = f"{prose(5)} {cue}"
        docs.append((i, f"{head}{value} {prose(3)} {rng.choice(others)()} {prose(2)}"))
        planted.add((i, kind, len(head), len(head) + len(value)))
    out = pii.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    base = {k: sum(r[f"n_{k}"] for r in out) for k in ("email", "ip", "phone")}
    assert min(base.values()) > 60
    spans = {(r.doc_id, k, int(s), int(e)) for r in out for k, s, e in (x.split(":") for x in r.spans.split(",") if x)}
    found = {s for s in spans if s[0] >= 400}
    right = found & planted
    recall = {kind: sum(s[1] == kind for s in right) / 20 for kind in unseen}
    assert len(right) >= 0.9 * len(found), found - planted
    assert min(recall.values()) >= 0.5 and len(right) >= 0.85 * len(planted), recall
    assert sum(r.n_learned for r in out) >= len(right)
    assert sum(r.n_learned for r in out if r.doc_id < 400) <= 4  # clean numbers beside seeds stay alone
