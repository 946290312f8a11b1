import random

import numpy as np

from curioshelf.llm import toxicity as tox


def corpus(seed, n):
    """Ordinary words; toxic texts have a few insults, known ones or of two made-up stems."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        bad = r.random() < 0.15
        words = ["".join(r.choice("aeilnorst") for _ in range(r.randrange(3, 8))) for _ in range(r.randrange(20, 120))]
        for _ in range(r.randrange(4, 9) if bad else 0):
            insult = r.choice(["idiot", "scum", "Loser,", "vequ" + r.choice("abcdefgh") * 2, "chlla" + r.choice("abcdefgh")])
            words.insert(r.randrange(len(words)), insult)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_label_model_finds_who_is_right():
    r = np.random.default_rng(5)
    y = r.random(4000) < 0.2
    good = np.where(r.random((4000, 3)) < 0.9, y[:, None], ~y[:, None]).astype(int)
    guess = (r.random((4000, 1)) < 0.5).astype(int)
    copies = np.repeat(np.where(r.random((4000, 1)) < 0.7, y[:, None], ~y[:, None]).astype(int), 3, axis=1)
    votes = np.concatenate((good, guess, copies), axis=1)
    votes[r.random(votes.shape) < 0.1] = -1
    p, table, weights = tox.label_model(votes, 0.2)
    assert np.mean((p > 0.5) == y) > 0.95
    accuracy = table[1, :, 0] - table[0, :, 0]
    assert accuracy[:3].min() > accuracy[4:].max() > accuracy[3]
    assert weights[4:].max() < weights[:4].min()


def test_held_out(spark, docs_of, odd_docs):
    rows = corpus(2, 1500)
    docs = docs_of([r[:2] for r in rows])
    labels = spark.createDataFrame([*((i, t) for i, _, t in rows[:1000]), (None, 1), (1200, None), (10**9, 1)], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    got = {r["doc_id"]: r["toxicity_score"] for r in tox.score(docs, model).collect()}
    held = rows[1000:]
    caught = [got[i] >= tox.THRESHOLD for i, _, t in held if t]
    wrong = [got[i] >= tox.THRESHOLD for i, _, t in held if not t]
    assert np.mean(caught) > 0.95 and np.mean(wrong) < 0.02
    odd = tox.score(odd_docs, model, ("score", "doc_id"))
    assert odd.columns == ["score", "doc_id", "toxicity_score"] and odd.count() == odd_docs.count()
    assert odd.where("toxicity_score >= 0.3 or toxicity_score is null").count() == 0
    assert tox.score(odd_docs.limit(0), model).count() == 0


def test_without_labels(spark, docs_of):
    docs = docs_of(["idiot scum", "hello"])
    model = tox.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert docs.count() == 2 and tox.score(docs, model).where("toxicity_score > 0.1").count() == 0
