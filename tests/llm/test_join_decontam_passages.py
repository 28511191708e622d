"""Similarity operators against brute force."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grafthorn.llm import decontam, ngram_join, passages
from grafthorn.llm.components import components

WORD = re.compile(r"\w+")


def words_of(text):
    return WORD.findall((text or "").lower())


def shingles(text, n=5):
    w = words_of(text)
    n = min(n, len(w))
    return [tuple(w[p : p + n]) for p in range(len(w) - n + 1)] if w else []


def some_words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(1)
    base = some_words(rng, 200)
    out = [(10**6, ""), (10**6 + 1, None), (10**6 + 2, "a b"), (10**6 + 3, "A, b!"), (10**6 + 3, "A, b!"), (None, "a b"), (None, None), (5, "lone text of its own words here")]
    for k in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append((k + 10, " ".join(w)))
    return out


def brute_classes(docs):
    """Each row's class (the least id in it) and links, by comparing all pairs."""
    sets = [frozenset(shingles(t)) for _, t in docs]
    label, links = list(range(len(sets))), [0] * len(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and len(a & b) / len(a | b) >= 0.8:
                links[i] += 1
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min((d for (d, _), y in zip(docs, label, strict=True) if y == x and d is not None), default=None) for x in label}
    return [least[x] if s else d for (d, _), x, s in zip(docs, label, sets, strict=True)], links


def test_classes_and_links(docs_of, near_copies, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 32)
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in ngram_join.near_duplicates(docs_of(near_copies)).collect())
    want = sorted((str(d), str(c), n) for (d, _), c, n in zip(near_copies, *brute_classes(near_copies), strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert sum(abs(g[2] - w[2]) for g, w in zip(got, want, strict=True)) <= 0.002 * sum(w[2] for w in want)


def test_one_of_each(docs_of, near_copies):
    docs = docs_of(near_copies)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = brute_classes(near_copies)[0]
    stay = {d for (d, _), c in zip(near_copies, classes, strict=True) if d is not None and d == c}
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d: 1 for d in stay} | {None: 2})


def test_overlap_sizes():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(12)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]
    assert ngram_join.overlaps(sets[:5], sets[5:]).tolist() == want


def test_components(spark):
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {f"n{i:02}": "n00" for i in range(21)} | {"x": "x", "y": "x"}
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_leaks(spark, docs_of):
    rng = random.Random(2)
    items = [(i, " ".join(some_words(rng, rng.randrange(14, 60)))) for i in range(30)] + [(900, "What about short"), (901, None), (902, "")]
    docs = [(1, ""), (2, None), (3, "xx what about short yy"), (4, "what about"), (5, " ".join(some_words(rng, 300)))]
    for k in range(120):
        w = rng.choice(items[:30])[1].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.choice([0, len(w) - 1, rng.randrange(len(w))])
            w[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"]])
        docs.append((100 + k, " ".join(some_words(rng, rng.choice([0, 3, 40])) + w + some_words(rng, rng.choice([0, 5])))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(docs_of(docs), bench).collect()}
    parts = [(i, shingles(t)) for i, t in items if words_of(t)]
    seen = Counter(s for _, p in parts for s in set(p))
    weight = lambda s: np.log1p(len(parts) / seen[s]) if s in seen else np.log1p(len(parts))
    for d, text in docs:
        want = set()
        for i, item in parts:
            own, bag = shingles(text, len(item[0])), Counter(item)
            for first in range(-len(item) + 1, len(own)):
                part = Counter(own[max(0, first) : first + len(item)])
                both = sum(min(n, bag[s]) * weight(s) for s, n in part.items())
                every = sum(max(part[s], bag[s]) * (weight(s) if s in bag else np.log1p(len(parts))) for s in {*part, *bag})
                if both / every >= 0.8 - 1e-9:
                    want.add(i)
        assert set(got[d].item_ids) == want and got[d].contaminated == bool(want)
    clean = decontam.without_leaks(docs_of(docs), bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs if not got[d].contaminated} and clean.columns == docs_of(docs).columns


def test_benchmark_in_parts(spark, docs_of, monkeypatch):
    rng = random.Random(4)
    template = some_words(rng, 9)
    items = [(i, " ".join(template + some_words(rng, rng.randrange(12, 20)))) for i in range(40)] + [(90, None), (91, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(7, f"{items[3][1]} and {items[30][1]}"), (8, "none"), (9, None)]
    for k in range(60):
        w = rng.choice(items[:40])[1].split()
        for _ in range(rng.choice([1, 1, 2])):
            w[rng.randrange(len(w))] = "new"
        docs.append((100 + k, " ".join(some_words(rng, 6) + w)))

    def found():
        return {r.doc_id: (r.item_ids, round(r.similarity, 12)) for r in decontam.contaminated(docs_of(docs), bench).collect()}

    whole = found()
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 15)
    monkeypatch.setattr(decontam, "CHAIN", 2)
    assert found() == whole and whole[7][0] == [3, 30] and whole[8] == whole[9] == ([], 0.0)
    assert any(0.8 <= s < 1 for _, s in whole.values())
    assert not decontam.contaminated(docs_of([(1, "a b c")]), bench.limit(0)).first().contaminated
    assert decontam.contaminated(docs_of([(1, "a")]).limit(0), bench).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_sliding_windows(seed, monkeypatch):
    """Fingerprints and similarities that slide are those of each window by itself, also where windows are cut in spans."""
    rng = random.Random(seed)
    monkeypatch.setattr(decontam, "SPAN", 40)
    monkeypatch.setattr(decontam, "WIDE", rng.choice([0, 10_000]))
    kinds = [f"w{k}" for k in range(rng.choice([6, 400]))]
    items = [(i, " ".join(rng.choices(kinds, k=rng.randrange(5, 30)))) for i in range(4)]
    text = " ".join(rng.choices(kinds, k=40) + items[0][1].split() + rng.choices(kinds, k=90) + (items[1][1] + " new").split() * 3 + rng.choices(kinds, k=40))
    index = decontam.BenchmarkIndex(items, radius=64)
    own = decontam.shingle_hashes(text, decontam.WordHashes())
    want = {}
    for size, starts in index.windows(5, own):
        assert (np.diff(starts) > 0).all() and np.array_equal(np.concatenate(decontam.runs(starts, size)), starts)
        for s in starts.tolist():
            part = own[max(s, 0) : s + size]
            (print_,) = decontam.simhashes(own, index.weights(own), np.array([max(s, 0)]), np.array([min(s + size, len(own))]))
            assert int(print_) == decontam.simhash(part, index.weights(part))
            for i in range(4):
                want[i] = max(want.get(i, 0), index.similarity(i, Counter(part.tolist())))
    got = index.matches(text, decontam.WordHashes())
    # With a radius of all bits the windows alone decide; blocks that differ by more than the index lists can hide a dissimilar item only.
    assert {i: s for i, s in want.items() if s >= 0.8} == pytest.approx(got) and 0 in got and 1 in got


def test_starts_around_places():
    rng = random.Random(8)
    for _ in range(200):
        places = np.array(sorted(rng.sample(range(60), rng.randrange(1, 9))))
        size = rng.randrange(1, 20)
        assert decontam.starts_around(places, size).tolist() == sorted({p - k for p in places.tolist() for k in range(size)})


def test_a_long_item_in_a_long_text():
    rng = random.Random(9)
    words = [f"w{rng.randrange(30_000)}" for _ in range(50_000)]
    index = decontam.BenchmarkIndex([(1, " ".join(words)), (2, " ".join(words[:40])), (3, "other words that are not in it")])
    edited = [w if k % 300 else "new" for k, w in enumerate(words)]
    assert index.matches(" ".join([*words[::-1], *edited, *words[::-1]]), decontam.WordHashes()).keys() >= {1}
    assert not index.matches(" ".join(words[::-1]), decontam.WordHashes())


def test_hamming_blocks_guarantee():
    rng = random.Random(5)
    blocks = decontam.hamming_blocks()
    assert len(blocks) == decontam.BLOCKS and sum(m.bit_length() for _, m in blocks) == 64
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontam.RADIUS):
            b ^= 1 << bit
        assert any((a >> s) & m in decontam.near_keys((b >> s) & m, m, decontam.RADIUS // decontam.BLOCKS) for s, m in blocks)


def test_compact_windows():
    rng = np.random.default_rng(6)
    values = rng.permutation(60).astype(np.uint64) + np.uint64(1)
    found = list(zip(*passages.compact_windows(values, np.array([60]), 10), strict=True))
    for i in range(60):
        for j in range(i + 10, 61):
            least = i + int(values[i:j].argmin())
            assert sum(a <= i and c == least and b >= j for a, c, b in found) == 1


@pytest.mark.parametrize("most", [5, 10**9])
def test_compact_windows_of_many_texts(most):
    rng = np.random.default_rng(most)
    for _ in range(100):
        sizes = rng.integers(1, 60, 6)
        values = rng.integers(1, most, sizes.sum()).astype(np.uint64)
        got, want, at = set(zip(*(x.tolist() for x in passages.compact_windows(values, sizes, 10)), strict=True)), set(), 0
        for n in sizes.tolist():
            open_ = [(at, at + n)]
            while open_:
                first, end = open_.pop()
                if end - first >= 10:
                    least = first + int(values[first:end].argmin())
                    want.add((first, least, end))
                    open_ += [(first, least), (least + 1, end)]
            at += n
        # Inside a run of one value only the first and the last are kept.
        assert all(values[least] == values[least - 1] for _, least, _ in got ^ want) and (most == 5 or got == want)


def test_passages(docs_of):
    rng = random.Random(7)
    shared = [some_words(rng, n) for n in (55, 80, 120)]
    docs, planted = [(1, ""), (2, None), (3, "too short"), (4, "same " * 200), (4, "same " * 200)], []
    docs += [(5, " ".join(some_words(rng, 400))), (6, " ".join(some_words(rng, 30) + shared[0][:30]))]
    for k in range(60):
        p = list(rng.choice(shared))
        if k % 5 == 0:
            p[rng.randrange(len(p))] = f"edit{k}"
        before = some_words(rng, rng.randrange(80))
        planted.append((100 + k, len(before), len(before) + len(p), k % 5 == 0))
        docs.append((100 + k, " ".join(before + p + some_words(rng, rng.randrange(80)))))
    spans = defaultdict(list)
    for r in passages.repeated_passages(docs_of(docs)).collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
        assert r.similarity >= 0.8 and r.partner_id != r.doc_id
    assert set(spans) <= {p[0] for p in planted}
    missed = [p for p in planted if not any(a <= p[1] and b >= p[2] for a, b in spans[p[0]])]
    assert not [p for p in missed if not p[3]] and len(missed) <= 4


def test_no_rows(docs_of):
    empty = docs_of([(1, "x")]).limit(0)
    assert passages.repeated_passages(empty).count() == ngram_join.near_duplicates(empty).count() == 0


def test_passage_around_a_common_line(docs_of):
    rng = random.Random(8)
    line = some_words(rng, 48)
    docs, planted = [(k, " ".join(some_words(rng, 60) + line + some_words(rng, 60))) for k in range(60)], set()
    for k in range(6):
        passage = some_words(rng, 4) + line + some_words(rng, 4)
        for i in (1000 + k, 2000 + k):
            docs.append((i, " ".join(some_words(rng, 60) + passage + some_words(rng, 60))))
            planted.add((i, 60, 60 + len(passage)))
    found = passages.repeated_passages(docs_of(docs)).collect()
    assert {p[0] for p in planted} == {r.doc_id for r in found}
    assert all(any(r.doc_id == i and r.start_word <= a and r.end_word >= b for r in found) for i, a, b in planted)


def test_every_occurrence_of_a_passage(docs_of):
    rng = random.Random(9)
    passage = some_words(rng, 80)
    docs = [(1, " ".join(w for _ in range(12) for w in some_words(rng, 70) + passage)), (2, " ".join(passage))]
    found = [(r.start_word, r.end_word) for r in passages.repeated_passages(docs_of(docs)).collect() if r.doc_id == 1]
    assert all(any(a <= 150 * k + 70 and b >= 150 * k + 150 for a, b in found) for k in range(12))


def test_edited_passages_are_met_and_verified():
    rng, words = random.Random(10), passages.WordHashes()
    for n, at, cut, new in ((60, 25, 0, 1), (60, 25, 1, 0), (55, 20, 1, 1), (90, 45, 0, 9)):
        met = 0
        for _ in range(100):
            p = some_words(rng, n)
            q = [*p[:at], *some_words(rng, new), *p[at + cut :]]
            left, right = (passages.shingle_hashes(" ".join(some_words(rng, 60) + t + some_words(rng, 60)), words) for t in (p, q))
            keys = [set(passages.window_keys(t, np.array([len(t)]))[0].tolist()) for t in (left, right)]
            met += bool(keys[0] & keys[1])
            assert passages.shared_passages(left.tolist(), right.tolist()) and passages.shared_passages(right.tolist(), left.tolist())
        assert met >= 97


def test_long_texts_of_few_words(docs_of):
    """Repeats within a text, over hundreds of thousands of words, in time."""
    same, cycle = "same " * 100_000, "a b c d e f g " * 15_000
    docs = docs_of([(1, same), (2, same + "x"), (3, cycle), (4, cycle + "z"), (5, same), (6, None)])
    began = time.monotonic()
    classes = {r.doc_id: r.class_id for r in ngram_join.near_duplicates(docs).collect()}
    assert classes[3] == classes[4] == 3 and classes[1] == classes[5] == 1 and classes[6] == 6
    found = {r.doc_id: (r.start_word, r.end_word) for r in passages.repeated_passages(docs).collect()}
    assert set(found) == {1, 2, 3, 4, 5} and found[1] == found[5] == (0, 100_000) and found[3] == (0, 105_000)
    assert time.monotonic() - began < 120


def test_runs_of_windows_hold_what_their_windows_hold():
    rng, words = random.Random(11), passages.WordHashes()
    merged = 0
    for _ in range(60):
        line = some_words(rng, rng.choice((1, 2, 5, 20, 23, 24, 30)))
        text = some_words(rng, rng.randrange(40)) + line * rng.randrange(4, 60) + some_words(rng, rng.randrange(40))
        tokens = passages.shingle_hashes(" ".join(text), words)
        keys, places, _ = passages.window_keys(tokens, np.array([len(tokens)]))
        order = np.lexsort((places[:, 2], keys))
        keys, (_, first, least, end) = keys[order], places[order].T
        starts = passages._runs(keys, np.zeros(len(keys), int), least)
        for i in np.nonzero(~starts)[0]:
            merged += 1
            assert end[i] == end[i - 1] and least[i - 1] < first[i] <= least[i] <= least[i - 1] + passages.HALF < end[i - 1]
    assert merged > 1000


def test_links_follow_runs(spark, docs_of):
    """Texts that repeat a line hundreds of times have about as many links as those that have it a few times. A cycle's edges may be off by half a passage."""
    rng = random.Random(12)
    line, texts = some_words(rng, 7), []
    for n in (10, 300):
        texts += [" ".join(some_words(rng, 30) + line * n + some_words(rng, 30)) for _ in range(2)]
    docs = docs_of(list(enumerate(texts)))
    linked = passages._links(passages.windows(docs.select(F.col("doc_id").alias("uid"), "text"))).where("greatest(uid, other) < 2 or least(uid, other) > 1")
    few, many = (linked.where(c).count() for c in ("uid < 2", "uid > 1"))
    assert 0 < many <= 3 * few
    found = {r.doc_id: (r.start_word, r.end_word) for r in passages.repeated_passages(docs).collect()}
    assert all(found[i][0] <= 30 + passages.HALF and found[i][1] >= 30 + 7 * n - passages.HALF for i, n in ((0, 10), (1, 10), (2, 300), (3, 300)))


def test_no_passage_of_a_large_group_is_lost(docs_of):
    """Pairs of equal passages among many others that are too far from them to be passages, but share most keys with them."""
    rng = random.Random(13)
    base = some_words(rng, 50)
    docs = [(k, some_words(rng, 60)) for k in range(5)]
    for k in range(120):
        own = list(base)
        at = rng.randrange(6, 42)
        own[at : at + 2] = f"edit{k}a", f"edit{k}b"
        docs += [(100 * (k + 1) + i, some_words(rng, 40) + own + some_words(rng, 40)) for i in range(2)]
    found = defaultdict(list)
    for r in passages.repeated_passages(docs_of([(i, " ".join(w)) for i, w in docs])).collect():
        found[r.doc_id].append((r.start_word, r.end_word))
    assert set(found) == {i for i, _ in docs if i >= 100}
    assert all(any(a <= 40 and b >= 90 for a, b in spans) for spans in found.values())


@pytest.mark.parametrize("seed", range(3))
def test_dense_stretches_and_tokens_to_look_up(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        common = rng.random(int(rng.integers(passages.LENGTH, 160))) < rng.choice([0.6, 0.8, 0.9])
        at = np.flatnonzero(rng.random(len(common)) < 0.2)
        total = np.concatenate([[0], np.cumsum(common)])
        dense = [(a, b) for a in range(len(common)) for b in range(a + passages.LENGTH, len(common) + 1) if total[b] - total[a] >= passages.THRESHOLD * (b - a) - 1e-9]
        want = [any(a <= p < b for a, b in dense) for p in at.tolist()]
        assert passages.within_dense(at, common).tolist() == want
        if any(want):
            low, high = int(at[want][0]), int(at[want][-1])
            lo, hi = passages.dense_hull(at[want], common)
            assert lo == min(a for a, b in dense if a <= low < b) and hi == max(b for a, b in dense if a <= high < b)
    places = [[int(p)] for p in np.flatnonzero(rng.random(400) < 0.7)]
    kept = passages.indispensable(places, rng.integers(65, 900, len(places)).tolist())
    dropped = np.array([p[0] for p, k in zip(places, kept, strict=True) if not k])
    assert kept.any() and max(((dropped >= a) & (dropped < a + 2 * passages.LENGTH - 1)).sum() for a in range(400)) < passages.NEEDED


@pytest.mark.parametrize("seed", range(4))
def test_pairs_compared_in_a_cell(seed, monkeypatch):
    """Every pair that shares a passage of short length goes to the comparison, both sides whole, and has a token that is asked for."""
    for name, value in (("LENGTH", 6), ("NEEDED", 5), ("_RUN", 11)):
        monkeypatch.setattr(passages, name, value)
    rng, shared = np.random.default_rng(seed), 0
    for _ in range(150):
        base = rng.integers(0, rng.choice([6, 1000]), 14)
        texts = [np.where(rng.random(14) < 0.1, rng.integers(2000, 9000, 14), base) for _ in range(2)]
        if rng.random() < 0.5:
            texts[1] = np.concatenate([rng.integers(2000, 9000, rng.integers(4)), np.delete(texts[1], rng.integers(14)), rng.integers(2000, 9000, 3)])
        left, right = (t.tolist() for t in texts)
        free, calls = rng.random(14) < 0.4, []
        monkeypatch.setattr(passages, "_passages", lambda x, y: calls.append((x.tolist(), y.tolist())) or [])  # noqa: B023
        passages.compared_runs([[1, 1, 0, texts[0], free]], [[2, 2, 0, texts[1], free]])
        counts = {t: int(rng.integers(2, 200)) if t in right else 1 for t in left}
        asked = passages.tokens_to_ask(texts[0], free, np.array([counts[t] for t in left])).tolist()
        for a in range(14):
            for b in range(a + 6, 15):
                for c in range(len(right)):
                    for d in range(c + 6, len(right) + 1):
                        x, y = set(left[a:b]), set(right[c:d])
                        both = x & y
                        if 5 * len(both) < 4 * len(x | y) or not {left[a], left[b - 1], right[c], right[d - 1]} <= both or not any(free[p] and left[p] in both for p in range(a, b)):
                            continue
                        shared += 1
                        assert both & set(asked)
                        assert any("".join(map("{},".format, left[a:b])) in "".join(map("{},".format, x)) and "".join(map("{},".format, right[c:d])) in "".join(map("{},".format, y)) for x, y in calls)
    assert shared > 500


def test_a_large_group_is_not_compared_in_all_pairs(monkeypatch):
    """Of texts that all share passages, each is compared until its tokens are covered, in about as many comparisons as there are texts."""
    rng, words, compare, runs = random.Random(14), passages.WordHashes(), passages._passages, []
    base = some_words(rng, 150)
    for k in range(120):
        own = list(base)
        for at in rng.sample(range(150), 8):
            own[at] = f"edit{k}x{at}"
        tokens = passages.shingle_hashes(" ".join(own), words).view(np.int64)
        runs.append([k, k, 0, tokens, np.ones(len(tokens), bool)])
    calls, covered, want = [], defaultdict(set), defaultdict(set)
    monkeypatch.setattr(passages, "_passages", lambda x, y: calls.append(1) or list(compare(x, y)))
    for _, doc, first, end, _, _ in passages.compared_runs(runs, runs):
        covered[doc] |= set(range(first, end))
    assert len(calls) < 12 * len(runs)
    for k, r in enumerate(runs[:20]):
        for o in runs:
            for a, b, c, d, _ in compare(r[3], o[3]) if o is not r else ():
                want[k] |= set((a + np.flatnonzero(np.isin(r[3][a:b], o[3][c:d]))).tolist())
        assert want[k] <= covered[k]


def _near_copies(rng, count, edits):
    base = some_words(rng, 150)
    return [(k, " ".join(f"edit{k}x{i}" if i in at else w for i, w in enumerate(base))) for k in range(count) for at in [set(rng.sample(range(150), edits))]]


def test_shuffles_go_with_their_step(spark, docs_of):
    """What one step shuffled isn't on the disk any more when the next step has run."""
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(folder.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    found = passages.repeated_passages(docs_of(_near_copies(random.Random(15), 20, 3)))
    time.sleep(1)
    assert not files() - before
    assert {r.doc_id for r in found.collect()} == set(range(20))


def test_cells_in_rounds_find_the_same(docs_of, monkeypatch):
    """Cells that are shuffled a few at a time, as the disk allows, give what all of them give."""
    docs = docs_of(_near_copies(random.Random(16), 30, 9))
    monkeypatch.setattr(passages, "_CELL_ROWS", 1000)
    monkeypatch.setattr(passages, "_CELL_COLUMNS", 2000)
    seen, compared = [], passages._compared
    monkeypatch.setattr(passages, "_compared", lambda cells: seen[-1].append(1) or compared(cells))
    for copies in (10**6, 2):
        monkeypatch.setattr(passages, "_COPIES", copies)
        seen.append([])
        seen[-1].append(sorted(tuple(r) for r in passages.repeated_passages(docs).collect()))
    assert len(seen[0]) == 2 and len(seen[1]) > 3 and seen[0][-1] == seen[1][-1]


def test_tokens_are_those_of_the_words():
    """Words as the regular expression finds them, and equal tokens for equal words alone; a text cut at its words keeps its tokens."""
    rng, texts = random.Random(17), []
    for _ in range(300):
        texts.append("".join(rng.choice("ab_1Ä ßΣς٣½²é‍漢\U0001d7d8\U0001f600\n-.,'") for _ in range(rng.randrange(200))).lower())
    texts += ["x" * 64 + " " + "x" * 65 + " " + "y" * 5000, ""]
    seen = {}
    for text in texts:
        starts, ends, hashes = passages.words_of(text)
        found = [text[a:b] for a, b in zip(starts, ends, strict=True)]
        assert found == passages.WORD.findall(text)
        assert all(seen.setdefault(w, int(h)) == int(h) for w, h in zip(found, hashes, strict=True))
        tokens = passages.tokens_of(text)
        if len(found) >= 15:
            assert np.array_equal(passages.tokens_of(passages._cut(text, starts, ends, 3, 9)), tokens[3:9])
            assert np.array_equal(passages.tokens_of(passages._cut(text, starts, ends, 3, len(tokens))), tokens[3:])
    assert len(set(seen.values())) == len(seen) > 1000


def test_each_comparison_covers_what_lies_in_a_passage(monkeypatch):
    """A stretch that is cut apart at its widest gap is covered all the same where it is a passage, so further pairs aren't compared for it."""
    rng = np.random.default_rng(18)
    base = rng.integers(0, 2**62, 160)
    calls, compare, runs = [], passages._passages, []
    monkeypatch.setattr(passages, "_passages", lambda x, y: calls.append(1) or list(compare(x, y)))
    # Three stretches, of which the first two and the last two make a passage, but not all three.
    for k in range(40):
        own = base.copy()
        own[50:58], own[108:118] = rng.integers(0, 2**62, 8), rng.integers(0, 2**62, 10)
        runs.append([k, k, 0, own, np.arange(160) >= 118])
    out = passages.compared_runs(runs, runs)
    assert len(calls) <= 3 * len(runs)
    covered = defaultdict(set)
    for _, doc, first, end, _, similarity in out:
        assert similarity >= 0.8 - 1e-9
        covered[doc] |= set(range(first, end))
    assert all(set(range(118, 160)) <= covered[k] for k in range(40))
