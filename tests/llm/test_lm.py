import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from hearthline.llm import lm
from hearthline.llm.entry import op3_lm_scoring
from tests.llm.conftest import SMALL, as_dicts


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def brute(rows):
    out_fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(t for i, x in rows if not out_fold(i) for t in tokens(x))
    n, v = c.total(), len(c)
    for i, x in rows:
        own = tokens(x)
        yield i, out_fold(i), len(own), sum(c[t] > 0 for t in own), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)


def check(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    want = sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_whole_table(spark, small_rows):
    got = as_dicts(op3_lm_scoring(spark, SMALL))
    check(got, brute([(r["doc_id"], r["text"]) for r in small_rows]))
    unseen = [r for r in got if r["held_out"]]
    # Held-out text is likelier under the model than under the unigrams.
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_counts_and_rare_words(spark, small, small_rows, monkeypatch):
    """A head too small for the vocabulary sends most words through the join."""
    monkeypatch.setattr(lm, "HEAD_WORDS", 50)
    monkeypatch.setattr(lm, "HOLD_WORDS", 40)
    check(as_dicts(lm.score_documents(small)), brute([(r["doc_id"], r["text"]) for r in small_rows]))


def trained(code, unigram, steps, batch, **how):
    """A model after steps over draws of the trigrams u, v, w of classes."""
    model, rng = lm.LogBilinear(np.asarray(unigram, float), **how), np.random.default_rng(1)
    for _ in range(steps):
        u, v, w = code[rng.integers(0, len(code), batch)].T
        model.step(u * model.size, v * model.size, w)
    return model


def loop_log10(model, u, v):
    """log10 P of every class after the codes u, v, by plain sums."""
    p, c = model.p, model.size
    r = lambda x: [float(a) + float(b) for a, b in zip(p["R"][x // c], p["S"][x % c], strict=True)]
    times = lambda x, m: [sum(x[i] * float(m[i][j]) for i in range(len(x))) for j in range(len(x))]
    h = [a + b for a, b in zip(times(r(u), p["A"]), times(r(v), p["B"]), strict=True)]
    energy = lambda vectors, biases: [math.exp(sum(a * float(b) for a, b in zip(h, q, strict=True)) + float(z)) for q, z in zip(vectors, biases, strict=True)]
    groups, classes = energy(p["G"], p["g"]), energy(p["Q"], p["b"])
    within = [sum(classes[x] for x in range(c) if model.group[x] == k) for k in range(len(groups))]
    return [math.log10(groups[model.group[x]] / sum(groups) * classes[x] / within[model.group[x]]) for x in range(c)]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    code = np.stack([rng.integers(0, 16, 5000), rng.integers(0, 16, 5000), rng.integers(0, 4, 5000)], axis=1)
    unigram = np.bincount(code[:, 2], minlength=16) + 1
    u, v, w = (x.ravel() for x in np.meshgrid(*[np.arange(16)] * 3, indexing="ij"))
    whole = []
    for steps in (0, 200):
        model = trained(code, unigram, steps, 256, width=8)
        assert 1 < len(model.begin) - 1 < 16 and sorted(set(model.group)) == list(range(len(model.begin) - 1))
        table = model.scorer()(u * 16, v * 16, w).reshape(16, 16, 16)
        assert (10.0**table).sum(axis=2) == pytest.approx(np.ones((16, 16)), abs=1e-5)
        assert table[3, 5] == pytest.approx(loop_log10(model, 3 * 16, 5 * 16), abs=1e-4)
        whole.append(table[tuple(code.T)].sum())
    assert whole[1] > whole[0]


@pytest.mark.parametrize("unigram", [[1, 1, 1, 1], [1, 1000, 1000, 1], [1, 100, 1, 1]])
def test_order_matters(unigram):
    """NCE learns that 1 follows (0, 0) and 2 follows (1, 1), whether they share a group or not."""
    model = trained(np.array([[0, 0, 1], [1, 1, 2]]), unigram, 400, 128, width=8)
    got = 10.0 ** model.scorer()(np.array([0, 4]), np.array([0, 4]), np.array([1, 2]))
    assert (got > 0.8).all()


def test_score_of_a_text_word_by_word(spark, small, small_rows, monkeypatch):
    """score against a loop over the words, from the parameters and the counts alone."""
    made = []
    train = lm.train_model
    monkeypatch.setattr(lm, "train_model", lambda texts, vocabulary: made.append((train(texts, vocabulary), vocabulary)) or made[0][0])
    got = {r["doc_id"]: r["score"] for r in as_dicts(lm.score_documents(small))}
    model, vocabulary = made[0]
    codes, c = vocabulary.codes(), Counter(t for r in small_rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1 for t in tokens(r["text"]))
    klass = lambda t: codes[t] // vocabulary.size
    whole = Counter()
    for t, n in c.items():
        whole[klass(t)] += n + 0.5
    short = sorted((r for r in small_rows if r["text"]), key=lambda r: len(r["text"]))[:12]
    assert {r["doc_id"] for r in short}
    for r in short:
        own, want = tokens(r["text"])[:400], 0.0
        if len(own) == 400:
            continue
        for i, t in enumerate(own):
            u, v = (codes[own[j]] if j >= 0 else codes[b""] for j in (i - 2, i - 1))
            share = 0.0 if t in vocabulary.top else math.log10((c[t] + 0.5) / (whole[klass(t)] + 0.5))
            want += loop_log10(model, u, v)[klass(t)] + share
        assert got[r["doc_id"]] == pytest.approx(want, abs=1e-3 * len(own))


def test_odd_rows(odd, empty):
    got = as_dicts(lm.score_documents(odd))
    check(got, brute([(r["doc_id"], r["text"]) for r in odd.collect()]))
    same = [r["score"] for r in got if r["doc_id"] == 3]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])
    assert lm.score_documents(empty).count() == 0


def test_no_training_row(spark):
    fold = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = as_dicts(lm.score_documents(spark.createDataFrame([(fold, "a b")], "doc_id long, text string")))
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)


@pytest.mark.parametrize("rows", [40, 160])
def test_every_token_is_learnt_from(spark, small, small_rows, rows):
    """Each pass sees every training token, however many there are."""
    texts = spark.createDataFrame([(r["text"],) for r in small_rows[:rows]], "text string")
    model = lm.train_model(texts, lm.Vocabulary(lm.count_words(texts)), epochs=2)
    assert model.seen == 2 * sum(len(tokens(r["text"])) for r in small_rows[:rows])


def test_classes_grow_and_words_of_a_class_differ(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_CLASSES", 8)
    sizes = []
    for n in (400, 6400):
        texts = spark.createDataFrame([(f"w{i}x and w{i}x but",) for i in range(n)], "text string")
        sizes.append(lm.Vocabulary(lm.count_words(texts)).size)
    assert sizes == [20, 80]
    # Equally frequent words of one last byte, the first followed by "red", the other by "blue".
    rows = [(n, f"{a} {b} {a} {b}") for n, (a, b) in enumerate([("oneq", "red"), ("twoq", "blue")] * 400)]
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame([*rows, (10_001, "oneq red"), (10_002, "twoq red")], "doc_id long, text string")).collect()}
    assert got[10_001] > got[10_002] + 0.1


def step_by_rows(model, u, v, w, noise=64, inner=32, rate=0.05):
    """The step written plainly: a row for each token and for each draw, summed by its class at the end."""
    p, c, n = model.p, model.size, 1 / len(w)
    order = np.argsort(model.group[w], kind="stable")
    u, v, w = u[order], v[order], w[order]
    group, grad = model.group[w], {k: np.zeros_like(x) for k, x in p.items()}
    ru, rv = (p["R"][x // c] + p["S"][x % c] for x in (u, v))
    h = ru @ p["A"] + rv @ p["B"]
    back = np.zeros_like(h)

    def contrast(rows, real, fake, names, shift):
        vector, bias = (p[k] for k in names)
        true = (1 / (1 + np.exp(shift[real] - (h[rows] * vector[real]).sum(axis=1) - bias[real])) - 1) * n
        false = n / (1 + np.exp(shift[fake] - h[rows] @ vector[fake].T - bias[fake]))
        back[rows] += true[:, None] * vector[real] + false @ vector[fake]
        for at, x, one in ((real, true[:, None] * h[rows], true), (fake, false.T @ h[rows], false.sum(axis=0))):
            np.add.at(grad[names[0]], at, x)
            np.add.at(grad[names[1]], at, one)

    fake = np.minimum(np.searchsorted(model.group_draw, model.rng.random(noise)), len(model.group_draw) - 1)
    contrast(slice(None), group, fake, "Gg", model.group_noise + math.log(noise))
    for k in np.unique(group):
        fake = np.clip(np.searchsorted(model.class_draw, k + model.rng.random(inner)), model.begin[k], model.begin[k + 1] - 1)
        rows = np.flatnonzero(group == k)
        contrast(rows, w[rows], fake, "Qb", model.class_noise + math.log(inner))
    for x, k, r in ((u, "A", ru), (v, "B", rv)):
        grad[k] = r.T @ back
        np.add.at(grad["R"], x // c, back @ p[k].T)
        np.add.at(grad["S"], x % c, back @ p[k].T)
    for k, g in grad.items():
        model.squares[k] += g * g
        p[k] -= rate * g / np.sqrt(model.squares[k])


def test_step_is_that_of_its_rows_and_cheaper():
    """The same parameters as a row for each token and draw gives, in less than 0.6 of its CPU seconds."""
    size, rng, spent = 600, np.random.default_rng(4), []
    unigram = 1e6 / np.arange(1, size + 1)
    draw = lambda: np.minimum((size ** rng.random(lm.BATCH)).astype(int) - 1, size - 1)
    batches = [(draw() * size + draw(), draw() * size + draw(), draw()) for _ in range(12)]
    fast, plain = lm.LogBilinear(unigram), lm.LogBilinear(unigram)
    for batch in batches:
        began = time.process_time()
        fast.step(*batch)
        between = time.process_time()
        step_by_rows(plain, *batch)
        spent.append((between - began, time.process_time() - between))
        for k in fast.p:
            assert fast.p[k] == pytest.approx(plain.p[k], abs=2e-3), k
    assert min(x for x, _ in spent) < 0.6 * min(x for _, x in spent)


def test_coder_agrees_with_codes(spark, small, monkeypatch):
    """Head words by their number, the rest by its hash: the codes are those of `Vocabulary.codes`."""
    for head in (120_000, 50, 0):
        monkeypatch.setattr(lm, "HEAD_WORDS", head)
        vocabulary = lm.Vocabulary(lm.count_words(small.selectExpr("coalesce(text, '') text")))
        words = ["the", "never-met", "Été".lower(), *list(map(bytes.decode, list(vocabulary.head)[:200])), "x" * 50]
        words = [w.encode() for w in words if w]
        codes, coder = vocabulary.codes(), lm.Coder(vocabulary)
        number, code, rare = coder(words)
        assert code.tolist() == [codes[w] for w in words] and coder.end == codes[b""]
        assert rare == [w for w in words if w not in vocabulary.head] == [w for w, n in zip(words, number, strict=True) if n < 0]
