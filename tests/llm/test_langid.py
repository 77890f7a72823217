import random

import numpy as np

from fathomlake.llm import langid

from .conftest import row, rows

LETTERS = {"aa": "aeimnort", "bb": "bcdfgkuz", "cc": "ehlpqsvy"}


def prose(lang, seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_held_out_accuracy_and_calibration(make):
    fit = make([row(i, prose(c, 100 * i), c) for i in range(90) for c in LETTERS])
    model = langid.train(fit, max_rows=150)
    held = [(c, prose(c, 7 + 1000 * i, 12)) for i in range(60) for c in LETTERS]
    p = model.probabilities([t for _, t in held])
    right = np.array([model.classes[k] == c for k, (c, _) in zip(p.argmax(1), held)])
    assert right.mean() > 0.97
    assert abs(p.max(1).mean() - right.mean()) < 0.1
    assert (model.weights == 0).mean() > 0.3  # the first penalty makes weights vanish


def test_rare_label_is_trained_on(make):
    sizes = {"aa": 600, "a2": 600, "a3": 600, "bb": 600, "b2": 600, "cc": 6}
    docs = make([row(i, prose(c[0] * 2, 10_000 * k + i, 8), c) for k, (c, n) in enumerate(sizes.items()) for i in range(n)])
    model = langid.train(docs, max_rows=60)
    p = model.probabilities([prose("cc", 7_000_000 + i, 40) for i in range(50)])
    assert np.mean([model.classes[k] == "cc" for k in p.argmax(1)]) >= 0.9


def test_training_rows_of_each_label(make, monkeypatch):
    seen = []
    ftrl = langid.ftrl
    monkeypatch.setattr(langid, "ftrl", lambda rows, labels, n, **o: seen.append(np.bincount(labels, minlength=n).tolist()) or ftrl(rows, labels, n, **o))
    sizes = {"aa": 900, "bb": 300, "cc": 30, "dd": 3, "ee": 1}
    docs = [row(i, prose("aa", 10_000 * k + i, 5), c) for k, (c, n) in enumerate(sizes.items()) for i in range(n)] + [row(9, "one text again and again", "ff")] * 400
    langid.train(make(docs), max_rows=120)  # 20 a label, a fifth of which is held out
    langid.train(make(docs), max_rows=3)
    assert seen == [[16, 16, 16, 3, 1, 16], [1] * 6]


def test_document_frequencies_count_all_documents(make):
    texts = ["abc", "abd", "", None, "xyz" * 50, "abc"]
    df = langid.document_frequencies(make([row(i, t) for i, t in enumerate(texts)]))
    want = np.zeros(langid.DIM, int)
    for t in texts:
        grams = {t[i : i + n] for n in (1, 2, 3) for i in range(len(t or "") - n + 1)} if t else set()
        slots = set()
        for g in grams:
            slots.add(int(langid._slots(np.array([ord(c) for c in g], np.uint32))[len(g) - 1][0]))
        for s in slots:
            want[s] += 1
    assert (df == want).all()


def test_edge_cases(edge, empty):
    got = rows(langid.identify(edge))
    assert len(got) == edge.count()
    by = {}
    for i, lang, predicted, p in got:
        by.setdefault(i, []).append((lang, predicted, p))
    assert all(x[1] is None and x[2] is None for i in (3, 4, 5) for x in by[i])
    assert all(x[1] in ("en", "zz") and 0 < x[2] <= 1 for i in (1, 2, 6, 9) for x in by[i])
    assert by[1][0] == by[1][1] and 2**62 + 1 in by
    assert langid.identify(empty).count() == 0


def test_no_label_predicts_nothing(make):
    got = langid.identify(make([row(1, "text", None)])).collect()
    assert [tuple(r) for r in got] == [(1, None, None, None)]


def test_ftrl_without_penalties_learns_the_sign():
    data = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0]))] * 20
    w, _ = langid.ftrl(data, np.array([0, 1] * 20), 2, l1=0, l2=0)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]


def test_temperature_is_the_best_on_a_grid():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(400, 3)) * 5
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(z / 3)])
    loss = lambda t: -np.log(langid.softmax(z / t)[np.arange(400), y]).mean()
    t = langid.temperature(z, y)
    assert loss(t) <= min(loss(x) for x in np.linspace(0.5, 10, 60)) + 1e-4


def test_ftrl_equals_a_plain_one():
    """Coordinate by coordinate, in Python's own numbers, over the same order of rows."""
    rng = np.random.default_rng(8)
    rows = [(np.sort(rng.choice(40, 5, replace=False)), rng.random(5)) for _ in range(60)]
    labels = rng.integers(0, 3, 60)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.1
    z, n = {}, {}

    def weight(k, c):
        zk, p1, p2 = z.get((k, c), 0.0), (0.0 if k == "bias" else l1), (0.0 if k == "bias" else l2)
        return 0.0 if abs(zk) <= p1 else -(zk - (p1 if zk > 0 else -p1)) / ((beta + n.get((k, c), 0.0) ** 0.5) / alpha + p2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(60):
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist()), ("bias", 1.0)]
            w = {(k, c): weight(k, c) for k, _ in x for c in range(3)}
            s = [sum(v * w[k, c] for k, v in x) for c in range(3)]
            e = [np.exp(v - max(s)) for v in s]
            for c in range(3):
                for k, v in x:
                    g = v * (e[c] / sum(e) - (labels[i] == c))
                    old = n.get((k, c), 0.0)
                    z[k, c] = z.get((k, c), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w[k, c]
                    n[k, c] = old + g * g
    w, b = langid.ftrl(rows, labels, 3, alpha, beta, l1, l2, epochs=2, seed=7)
    want = np.array([[weight(k, c) for c in range(3)] for k in range(40)])
    assert np.allclose(w[:40], want, atol=1e-9) and np.allclose(b, [weight("bias", c) for c in range(3)], atol=1e-9)
    assert (w[40:] == 0).all() and (want == 0).any()


def test_a_prediction_by_hand(make):
    """One text scored with dictionaries of n-gram counts instead of arrays."""
    docs = make([row(i, prose(("aa", "bb")[i % 2], i).title(), ("aa", "bb")[i % 2]) for i in range(60)])
    m = langid.train(docs)
    text = docs.filter("doc_id = 6").first().text
    grams = {}
    for n, slots in zip((1, 2, 3), langid._slots(np.array([ord(c) for c in text.lower()], dtype=np.uint32))):
        for s in slots[: len(text) - n + 1].tolist():
            grams[s] = grams.get(s, 0) + 1
    x = {s: c * m.idf[s] for s, c in grams.items()}
    norm = sum(v * v for v in x.values()) ** 0.5
    scores = [(sum(v / norm * m.weights[s, c] for s, v in x.items()) + m.bias[c]) / m.temperature for c in range(2)]
    p = np.exp(scores) / np.exp(scores).sum()
    got = langid.identify(docs, model=m).filter("doc_id = 6").first()
    assert got.predicted == m.classes[int(p.argmax())] and abs(got.confidence - p.max()) < 1e-9
