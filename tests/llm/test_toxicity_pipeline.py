"""Held-out accuracy of the classifier, gradients, and the pipeline from end to end."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from grafthorn.llm import pii, queries, toxicity
from grafthorn.llm.common import written

BAD = ["zorgle", "vexing", "plimbat", "grubnar"]


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    out = []
    for i in range(420):
        w = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 160))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(["", "s", "en"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_gradients():
    rng = np.random.default_rng(0)
    width, h = toxicity._WIDTH, toxicity.HIDDEN
    p = {"v": rng.normal(size=2 * h), "w": rng.normal(size=2 * h), "b": np.zeros(1)}
    for side in "fb":
        p |= {"x" + side: 0.3 * rng.normal(size=(width, 3 * h)), "u" + side: 0.3 * rng.normal(size=(h, 3 * h)), "b" + side: 0.1 * rng.normal(size=3 * h)}
    p = {k: x.astype(np.float32) for k, x in p.items()}
    x, mask = rng.normal(size=(6, 4, width)).astype(np.float32), np.ones((6, 4), np.float32)
    mask[4:, 1] = mask[2:, 2] = 0
    y, one = np.array([0, 1, 1, 0], np.float32), np.ones(4, np.float32)
    _, g, dx = toxicity.gradients(x, mask, y, one, p)
    for k in p:
        at = tuple(rng.integers(n) for n in p[k].shape)
        near = []
        for step in (0.01, -0.01):
            moved = {a: b.copy() for a, b in p.items()}
            moved[k][at] += step
            near.append(toxicity.gradients(x, mask, y, one, moved)[0])
        assert abs((near[0] - near[1]) / 0.02 - g[k][at]) < 2e-3
    assert (dx[4:, 1] == 0).all()


def test_windows_cover_the_text():
    for n in (0, 1, 47, 48, 49, 100, 1000):
        cuts = toxicity.windows_of(n)
        assert cuts[0, 0] == 0 and cuts[-1, 1] == n and (cuts[1:, 0] < cuts[:-1, 1]).all() and (np.diff(cuts[:, 0]) == toxicity.STRIDE).all()


def test_held_out_accuracy(spark, labelled):
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in labelled] + [(1000, None, "en"), (1001, "", "en"), (1002, "zorgle " + "word " * 5000, "en")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, x) for i, _, x in labelled], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(labelled) + 3
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, x) for i, _, x in labelled if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.9 and got[1000].predicted == got[1001].predicted == 0
    assert got[1002].predicted == 1
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, labels).collect()] == [0.0]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def _shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def _least_of_classes(rows):
    """Least id of each row's class, by comparing all pairs of texts."""
    sets, label = [_shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and len(x & sets[j]) >= 0.8 * len(x | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if y == old else y for y in label]
    return {d: min(e for (e, _), y in zip(rows, label, strict=True) if y == own) if s else d for (d, _), own, s in zip(rows, label, sets, strict=True)}


def test_pipeline(spark):
    """Each stage's decisions against a plain version on that stage's own input."""
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    columns, items = docs.columns, [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = {r.doc_id: r.text for r in docs.collect()}, written(stage(spark, docs, d))
        now = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and docs.count() == len(now) and set(now) <= set(before)
        if name != "personal_data":
            assert all(now[i] == before[i] for i in now)
        if name == "toxicity":
            source = spark.read.parquet(f"{d}/documents.parquet")
            assert set(now) == {r.doc_id for r in toxicity.toxicity(source, labels).collect() if r.predicted == 0}
        if name == "near_duplicates":
            least = _least_of_classes(sorted(before.items()))
            assert set(now) == {i for i, x in least.items() if i == x}
        if name == "decontamination":
            flat = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
            holds = {i for i, t in before.items() if any(flat(x) in flat(t) for x in items if flat(x).strip())}
            assert holds and not holds & set(now) and len(before) - len(now) <= 2 * len(holds) + 2
        if name == "personal_data":
            assert set(now) == set(before) and not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", t or "") for t in now.values())
            assert {i for i in now if now[i] != before[i]} == {r.doc_id for r in pii.pii_spans(spark.createDataFrame(list(before.items()), "doc_id long, text string")).collect() if r.spans}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in pieces} == set(now)
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(r.length for r in pieces) // 4096) + 2


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_the_whole_word_is_read():
    words = toxicity._Words(["a" * 64 + "zorgle", "a" * 64 + "kindly", "a" * 200])
    grams = [set(words.flat[a:b].tolist()) for a, b in zip(words.start[:-1], words.start[1:], strict=True)]
    assert grams[0] != grams[1] and words.start[3] - words.start[2] == 200 + 199 + 198


def test_scores_against_a_plain_loop(labelled):
    """One word, step and window at a time, from the same weights."""
    model = toxicity.train([t for _, t, _ in labelled[:160]], [y for _, _, y in labelled[:160]])
    p = {k: x.astype(float) for k, x in model.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def input_of(word):
        w = toxicity._Words([word])
        odds = [float(model.gram_odds[g % toxicity.GRAM_SLOTS]) for g in w.flat]
        learned = np.mean([p["gram"][g % toxicity.LEARNED_SLOTS] for g in w.flat], axis=0)
        return np.concatenate([p["word"][w.word[0] % toxicity.LEARNED_SLOTS], learned, [model.word_odds[w.word[0] % toxicity.WORD_SLOTS], np.mean(odds), max(odds)]])

    def states(xs, side):
        h, out, n = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for x in xs:
            g, u = x @ p["x" + side] + p["b" + side], h @ p["u" + side]
            z, r = sigmoid(g[:n] + u[:n]), sigmoid(g[n : 2 * n] + u[n : 2 * n])
            c = np.tanh(g[2 * n :] + r * u[2 * n :])
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    def score(text):
        words, best = re.findall(r"\w+", (text or "").lower()), -np.inf
        for start in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            xs = [input_of(w) for w in words[start : start + toxicity.WINDOW]]
            both = [np.concatenate(s) for s in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
            a = np.exp([s @ p["v"] for s in both])
            best = max(best, float(sum(x * s for x, s in zip(a / a.sum(), both, strict=True)) @ p["w"] + p["b"][0])) if xs else best
        return sigmoid(best) if words else 0.0

    texts = [t for _, t, _ in labelled[160:190]] + [None, "", "one", labelled[0][1], labelled[0][1], "x" * 3000, "zorgle " * 200]
    scorer = toxicity._Scorer(model)
    got = [s for part in (texts[:7], texts[7:20], texts[20:]) for s in scorer(part)]
    assert np.allclose(got, [score(t) for t in texts], atol=1e-4)


def test_long_labelled_texts_are_learned_from(spark, labelled):
    long = [(i, t + " word" * 3000, x) for i, t, x in labelled[:60]]
    docs = spark.createDataFrame([(i, t) for i, t, _ in long], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in long], "doc_id long, toxic int")
    assert min(len(t) for _, t, _ in long) > toxicity.MAX_CHARS and toxicity.fit(docs, labels) is not None


def test_stages_touch_no_column_of_the_caller(spark, tmp_path):
    """Names that stages might use themselves come through all but the last with their values; nulls, repeats and ties too."""
    import corpus_pipeline

    names = ["_bucket", "_place", "_map", "_may", "bucket", "place", "map", "may", "x0", "key", "n", "_n", "score", "label", "row", "start", "sig", "text_key", "id", "class_id", "uid", "value"]
    words = [" ".join(f"w{(i * 7 + k * k) % 211}" for k in range(60)) for i in range(12)]
    rows = [(i, words[i % 9], "en", "s", len(words[i % 9]), *(f"{c}{i}" for c in names)) for i in range(12)] + [(20, None, None, None, None, *names), (21, "", "en", "s", 0, *names), (None, words[0], "en", "s", len(words[0]), *names), (3, words[3], "en", "s", len(words[3]), *(f"{c}3" for c in names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    for table, df in (("labels", spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, "nothing of the kind stands in any of these texts at all")], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{table}.parquet"))
    given = {r[0]: tuple(r) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        assert all(tuple(r) == given[r.doc_id] for r in docs.collect()), name
    # Of each group of copies the least id, rows without words or without an id whole, of repeated rows one.
    assert sorted((r.doc_id is None, r.doc_id) for r in docs.collect()) == [(False, k) for k in [*range(9), 20, 21]] + [(True, None)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 12
