"""The ten operators against brute force on small fixtures, and on the rows that break things."""

import base64
import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tulya.llm import decontaminate, kernels, kneserney, language, linededup, minhash, mixing, pseudolikelihood, rules, substrings, warc
from tulya.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(n=120, seed=3):
    """Random prose with copies, near copies, repeated lines, and odd rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéü") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [prose(60), prose(8), prose(9)]
    rows = []
    for i in range(n):
        lines = [prose(r.randint(3, 30)) for _ in range(r.randint(1, 6))]
        if i % 5 == 0:
            lines.insert(r.randint(0, len(lines)), r.choice(shared))
        rows.append((i, "\n".join(lines), "xy"[i % 2] * 2, f"s{i % 3}"))
    for i in range(n, n + 40):  # copies, some with a word changed
        text = rows[r.randrange(n)][1]
        if i % 2:
            words = text.split(" ")
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        rows.append((i, text, "xx", "s0"))
    odd = [None, "", "  \n\t ", "One", "ONE", "a b", "\n\n", "#*$ | <x>", "ॐ   z", ("w " * 5000).strip(), "é" * 3000]
    rows += [(1000 + i, t, None, None) for i, t in enumerate(odd)]
    rows += [(None, "no id here at all", "xx", "s1"), rows[0], rows[0]]
    return [(i, t, lang, s, len(t or ""), "x", "y") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def blank_words(t):
    return (t or "").translate(LOWER).encode().split()


# 1


def test_decontaminate_equals_brute_force(spark, rows, docs, empty):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    texts = dict((r[0], r[1]) for r in rows)
    items = [(1, texts[5]), (2, " ".join(words(texts[7])[2:14])), (3, "one"), (4, None), (5, "!!"), (2, " ".join(words(texts[7])[2:14])), (6, "never seen words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    report, _ = decontaminate.decontaminate(docs, bench)
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in report.collect()}
    want = set()
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            x = words(text)
            n = min(10, len(x))
            for a in range(len(x) - n + 1 if x else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == x[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(item))
        want.add((i, len(w), len(hit), tuple(sorted(found))))
    assert got == want
    assert decontaminate.decontaminate(empty, bench)[0].count() == 0
    clean, _ = decontaminate.decontaminate(docs, bench.limit(0))
    assert clean.filter("n_hit > 0").count() == 0


# 2


def test_language_learns_held_out_rows_and_handles_odd_ones(spark, empty):
    r = random.Random(1)
    letters = {"aa": "abcde", "bb": "vwxyz", "cc": "klmno"}
    rows = []
    for i in range(300):
        lang = sorted(letters)[i % 3]
        rows.append((i, " ".join("".join(r.choice(letters[lang]) for _ in range(4)) for _ in range(20)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.filter(~language.held_out("doc_id")))
    out = language.identify(docs, model).join(docs, "doc_id").filter(language.held_out("doc_id"))
    assert out.filter("lang = lang_pred").count() >= 0.9 * out.count() > 0
    assert out.filter("score < 0 or score > 1").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (None, "abcd")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == "aa"
    assert language.train(empty) is None
    assert language.identify(odd, None).filter("lang_pred != 'und'").count() == 0
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_a_score_depends_on_its_own_text_only(spark):
    import pyarrow as pa

    texts = ["abc de", "", "x", "vwx yzv wxy", None, "a" * 3000, "éè ü"]
    chars = lambda t: np.array([ord(c) for c in t.lower()], np.uint32)

    def alone(t):
        return language._places(chars(t), np.array([0, len(t)]))[0].tolist()

    for order in (texts, texts[::-1], texts[3:] + texts[:3]):
        for _, points, off in language._pieces(order):
            places, first = language._places(points, off)
            assert [places[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [alone(t or "") for t in order]
    # Brute force: an n-gram at each character and at the first closing blank.
    grams = {}
    for t in ("abc de", "c d", "bcx"):
        framed = t + "   "
        own = np.array(alone(t)).reshape(-1, 3)
        assert len(own) == len(t) + 1
        for i, row in enumerate(own):
            for n, place in zip(language.ORDERS, row, strict=True):
                assert grams.setdefault(framed[i : i + n] + str(n), place) == place
    docs = spark.createDataFrame([(i, t, "aa" if i % 2 else "bb") for i, t in enumerate(texts * 5)], "doc_id long, text string, lang string")
    model = language.train(docs)
    told = [{(r.doc_id, r.lang_pred, r.score) for r in language.identify(docs.repartition(n), model).collect()} for n in (1, 7)]
    assert told[0] == told[1] and pa


def test_temperature_makes_overconfident_scores_honest():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 4000)
    logits = np.zeros((4000, 2))
    right = rng.random(4000) < 0.8
    logits[np.arange(4000), np.where(right, labels, 1 - labels)] = 8
    t = language.temperature(logits, labels)
    p = 1 / (1 + np.exp(-8 / t))
    assert abs(p - 0.8) < 0.02


# 3


def test_line_dedup_equals_brute_force(rows, docs, empty):
    first, occ = {}, []
    key = lambda i: (i is not None, i if i is not None else 0)
    for i, t in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (key(r[0]), r[1] or "")):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            x = re.sub(r"[ \t\n\x0b\f\r]+", " ", line.lower()).strip(" ")
            if x:
                occ.append((i, k, x))
                first.setdefault(x, (key(i), k))
    groups = defaultdict(set)
    for x in first:
        w = tuple(x.split(" "))
        if 5 <= len(w) < 200:
            for v in [w, *(w[:j] + w[j + 1 :] for j in range(len(w)))]:
                groups[v].add(x)
    near = set()
    for g in groups.values():
        for x in g:
            for y in g:
                a, b = x.split(" "), y.split(" ")
                one = sum(p != q for p, q in zip(a, b)) == 1 if len(a) == len(b) else abs(len(a) - len(b)) == 1
                if x != y and one and first[y] < first[x]:
                    near.add(x)
    want = {(i, k) for i, k, x in occ if x in near or first[x] != (key(i), k)}
    got = {(r.doc_id, r.line_no) for r in linededup.removed_lines(docs).collect()}
    assert got == want and near
    assert linededup.dedup_lines(empty).count() == 0
    assert linededup.dedup_lines(docs).count() == docs.count()


def test_a_word_left_out_is_found_where_several_places_have_its_key(spark):
    docs = spark.createDataFrame([(1, "a x b c a x b"), (2, "a x b c a b")], "doc_id long, text string")
    assert [(r.doc_id, r.line_no, r.near) for r in linededup.removed_lines(docs).collect()] == [(2, 0, True)]


def test_the_bound_grows_with_a_line_and_short_lines_are_compared_by_characters(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]

    def changed(edits):
        w = list(base)
        for j in sorted(r.sample(range(0, 60, 2), edits), reverse=True):
            if j % 3 == 0:
                del w[j]
            elif j % 3 == 1:
                w.insert(j, f"new{j}")
            else:
                w[j] = f"x{j}"
        return " ".join(w)

    short = ["terms of use apply", "terms of use aply", "term of use apply", "all rights reserved", "chapter 11", "chapter 12", "abcdefghi", "abcdefghj"]
    rows = [(0, " ".join(base))] + [(i, changed(i)) for i in range(1, 11)]
    rows += [(100 + i, x) for i, x in enumerate(short)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in linededup.removed_lines(docs).collect()}
    assert {i for i in got if i >= 100} == {101, 102}
    for i in range(1, 11):  # removed if and only if an earlier one is within a word in ten
        near = any(10 * _edits(rows[i][1], rows[j][1]) <= max(len(x.split(" ")) for x in (rows[i][1], rows[j][1])) for j in range(i))
        assert (i in got) == near, i
    assert {2, 3, 4, 5} <= got


def _edits(a, b):
    a, b = a.split(" "), b.split(" ")
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, start=1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, start=1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


# 4


def test_mix_meets_targets_and_repeats_itself(spark, rows, docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    for s, t in target.items():
        biggest = max(r.size for r in out if r.source == s)
        assert abs(taken[s] - t) <= biggest / 2 + 1, (s, taken[s], t)
    again = sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert again == sorted(map(str, out))
    assert mixing.mix(empty).count() == 0


def test_mix_equals_brute_force(spark, rows, docs):
    sized = [(i, s, len(blank_words(t)), t) for i, t, _, s in (r[:4] for r in rows)]
    keys = docs.selectExpr("doc_id", "text", "xxhash64(text) as k", "xxhash64(7, cast(doc_id as string), xxhash64(text)) as u").collect()
    u_of = {(r.doc_id, r.text): (((r.u % 2**64) >> 11) + 0.5) / 2**53 for r in keys}
    sources = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, s or ""))
    total = [sum(n for _, s2, n, _ in sized if s2 == s) for s in sources]
    due = mixing.targets(list(zip(sources, total, strict=True)), (5, 2, 1), 3)
    got = {(r.doc_id, r.text_key): r.copies for r in mixing.mix(docs).collect()}
    key_of = {(r.doc_id, r.text): r.k for r in keys}
    unequal = set()
    for source, size, target in zip(sources, total, due, strict=True):
        own = [r for r in sized if r[1] == source and r[2]]
        m = [max(1, int(131072 * n * len(own) / (n * len(own) + size))) for _, _, n, _ in own]
        if target >= 3 * size:
            rate = float("inf")
        else:  # the rate that gives the target, by halving
            lo, hi = 0.0, 3.0 * 131072
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if sum(n * min(3, mid * x) for (_, _, n, _), x in zip(own, m, strict=True)) < target else (lo, mid)
            rate = hi
        copies = [min(3, rate * x) for x in m]
        left = target - sum(int(c + 1e-6) * n for c, (_, _, n, _) in zip(copies, own, strict=True))
        ranked = []
        for c, (i, _, n, t) in zip(copies, own, strict=True):
            p, u = c - int(c + 1e-6), u_of[i, t]
            if p > 1e-6:
                unequal.add(round(p, 6))
                ranked.append((u * (1 - p) / (u * (1 - p) + p * (1 - u)), i, t, n, int(c + 1e-6)))
        taken = 0
        for _, i, t, n, whole in sorted(ranked, key=lambda r: r[0]):
            same = sum(1 for r in own if r[0] == i and r[3] == t)
            if same > 1 or taken + n > left:
                break  # the cut; ties and the best fit are in other tests
            taken += n
            assert got[i, key_of[i, t]] == whole + 1
    assert len(unequal) > 20


def test_targets_stop_at_three_times_a_source():
    got = mixing.targets([("a", 10), ("b", 100), ("c", 0), (None, 1000)], (5, 2, 1), 3)
    assert got[0] == 30 and got[2] == 0 and got[1] <= 300 and sum(got) == pytest.approx(1110)


# 5


def test_loser_tree_merges_like_a_heap():
    r = random.Random(2)
    for _ in range(100):
        runs = [sorted(r.randint(0, 9) for _ in range(r.randint(0, 7))) for _ in range(r.randint(0, 9))]
        assert list(warc.merged(runs, key=lambda x: (x,))) == list(heapq.merge(*runs))


def test_warc_round_trip_and_index_order(spark):
    rows = [(i, f"http://h{i % 3}.com/p?b={i % 4}&a=1", "<p>é\r\n\r\n" + "x" * (i % 7)) for i in range(60)]
    rows += [(100, None, None), (101, "http://x", ""), (None, "http://y", "lonely"), (3, "http://h0.com/", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "test-warc")
    warc.write_archives(pages, path)
    index = warc.capture_index(warc.read_archives(spark, path), range_rows=20).orderBy("part", "nth").collect()
    assert [(r.url_key.encode(), r.ts) for r in index] == sorted((r.url_key.encode(), r.ts) for r in index)
    assert len(index) == len(rows) and len({r.part for r in index}) > 1
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        want[i, len(b), digest, "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index) == want
    path = new_path(spark, "test-warc")
    warc.write_archives(pages.limit(0), path)
    assert warc.capture_index(warc.read_archives(spark, path)).count() == 0


# 6


def test_network_gradient_and_normalisation():
    rng = np.random.default_rng(0)
    net = pseudolikelihood.Net(pseudolikelihood.Net.fresh().flat.astype(np.float64))
    grad = pseudolikelihood.Net(np.zeros(pseudolikelihood.SIZE))
    around, word = rng.integers(0, pseudolikelihood.SYMBOLS + 1, (40, 4)), rng.integers(0, pseudolikelihood.SYMBOLS, 40)
    net.log_probs(around, word, grad)
    for i in rng.choice(np.flatnonzero(grad.flat), 8):
        loss = []
        for step in (1e-6, -2e-6):
            net.flat[i] += step
            loss.append(-net.log_probs(around, word).mean())
        net.flat[i] += 1e-6
        assert (loss[0] - loss[1]) / 2e-6 == pytest.approx(grad.flat[i], abs=1e-6)
    every = np.arange(pseudolikelihood.SYMBOLS)
    assert np.exp(net.log_probs(np.repeat(around[:1], len(every), 0), every)).sum() == pytest.approx(1, abs=1e-4)


def test_pseudo_likelihood_learns(spark, docs, empty, rows):
    texts = spark.createDataFrame([(i, f"t{i} " + "one two three four " * 250) for i in range(98)] + [(99, None), (100, " ")], "doc_id long, text string")
    out = {r.doc_id: r for r in pseudolikelihood.pseudo_likelihood(texts).collect()}
    assert out[99].n_words == out[100].n_words == 0 == out[99].log_prob
    assert out[0].log_prob / out[0].n_words > -3  # far above a blind guess, -6.9
    assert pseudolikelihood.pseudo_likelihood(docs, rounds=1).count() == len(rows)
    assert pseudolikelihood.pseudo_likelihood(empty).count() == 0


def test_pseudo_likelihood_is_of_each_word_not_of_its_class(spark):
    """2,000 words seen once and 40 seen 20 times, all in hashed classes."""
    common = [f"top{i}" for i in range(960)]
    often, once = [f"often{i}" for i in range(40)], [f"once{i}" for i in range(2000)]
    rows = [(i, " ".join(common)) for i in range(25)]
    rows += [(100 + i, " ".join(often)) for i in range(20)] + [(200, " ".join(once)), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at_hand, joined = ({r.doc_id: r for r in pseudolikelihood.pseudo_likelihood(docs, at_hand=n).collect()} for n in (1 << 16, 500))
    assert len(at_hand) == len(joined) == len(rows)
    for i, r in at_hand.items():
        assert joined[i].log_prob == pytest.approx(r.log_prob, abs=1e-2)
    assert at_hand[100].log_prob / 40 > at_hand[200].log_prob / 2000 + 2

    counts = pseudolikelihood.word_counts(docs)
    known = pseudolikelihood.vocabulary_of(counts)[0]
    (hashes, shares, _), bound = pseudolikelihood.shares_of(counts, known)
    assert bound == 0 and len(hashes) == 3000
    rare = ~np.isin(hashes, known)
    sums = np.bincount((hashes[rare] % np.uint64(64)).astype(int), np.exp(shares[rare]), 64)
    assert sums[sums > 0] == pytest.approx(np.ones((sums > 0).sum()))  # all words of a class share its probability


# 7


def test_rule_counts_equal_brute_force(spark, rows, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.rule_verdicts(docs, labels).collect())
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        windows = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        hit = {p for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        want[i, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
             len(w) < 10 or 100 * len(hit) > 20 * len(w)] += 1
    assert got == want
    assert rules.rule_verdicts(empty, labels).count() == 0
    bare = rules.rule_verdicts(docs, labels.limit(0))
    assert bare.filter("kept = base_failed").count() == 0


def test_forest_isolates_odd_rows():
    rng = np.random.default_rng(0)
    usual = rng.normal(0, 1, (2000, 3))
    scores = rules.Forest(usual).scores(np.vstack([usual[:200], [[9, 9, 9]]]))
    assert scores[-1] > np.quantile(scores[:-1], 0.99)
    assert rules.best_cut(np.array([0, 5, 0]), np.array([0, 0, 0])) is None


# 8


def _perplexities(trained, scored):
    """Modified Kneser-Ney by its definition, over lists of symbols."""
    def grams(t):
        s = ["^"] * 3 + list(re.sub("[ \t-\r]+", " ", t or "")) + ["^"]
        return [tuple(s[i : i + 4]) for i in range(len(s) - 3)]

    levels = {4: Counter(g for t in trained for g in grams(t))}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {k: kneserney.discounts(*(list(c.values()).count(i) for i in range(1, 5))) for k, c in levels.items()}

    def p(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        counts = levels[len(g)]
        after = [n for h, n in counts.items() if h[:-1] == g[:-1]]
        if not after:
            return p(g[1:])
        cut = lambda n: cuts[len(g)][min(n, 3) - 1] if n else 0
        return (counts[g] - cut(counts[g]) + sum(map(cut, after)) * p(g[1:])) / sum(after)

    assert sum(p((*"abc", s[0])) for s in levels[1]) + p((*"abc", "never")) == pytest.approx(1)
    return [2 ** -np.mean([np.log2(p(g)) for g in grams(t)]) for t in scored]


def test_kneser_ney_equals_its_definition(spark):
    r = random.Random(4)
    odd = [None, "", "a", " \n\t a  b ", "વકીલ વ", "привет", "\U0001f600\U00020000x", "zzzz" * 90]
    texts = ["".join(r.choice("abcd \nવએ\U0001f600") for _ in range(r.randint(1, 60))) for _ in range(60)] + odd
    labels = spark.createDataFrame([(i, 1) for i in range(45)], "doc_id long, quality int")
    some = spark.createDataFrame([(i, t, "xx", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, gram long")
    kept_back = {r.doc_id for r in some.filter(kneserney._held_back("doc_id")).collect()}
    expected = _perplexities([t for i, t in enumerate(texts[:45]) if i not in kept_back], texts)
    out = {r.doc_id: r.perplexity for r in kneserney.perplexity_verdicts(some.repartition(1), labels).collect()}
    assert [out[i] for i in range(len(texts))] == pytest.approx(expected)


def test_grams_of_blocks_chunks_and_large_alphabets(monkeypatch):
    texts = ["ab", None, "", "a  b", "x" * 500, "".join(map(chr, range(0x3400, 0x3400 + 300))), "ab"]
    column = pa.array(texts)
    whole = kneserney.Grams(column)
    some, n = whole.distinct()
    strings = Counter(dict(zip(whole.strings(some).to_pylist(), n.tolist(), strict=True)))
    e = chr(kneserney.EDGE)
    framed = [e * 3 + re.sub(" +", " ", t or "") + e for t in texts]
    assert strings == Counter(f[i : i + 4] for f in framed for i in range(len(f) - 3))
    monkeypatch.setattr(kneserney, "CHUNK", 7)
    small = kneserney.Grams(column)
    assert np.array_equal(np.concatenate(list(small.numbers())), np.concatenate(list(whole.numbers())))
    points = [c for c in range(1, 0xD800) if c != kneserney.EDGE] + list(range(0x10000, 0x14000))
    monkeypatch.setattr(kneserney, "CHUNK", 1 << 20)
    many = kneserney.Grams(pa.array(["".join(map(chr, points)), "ab"]))
    assert many.pairs is not None
    some, n = many.distinct()
    assert n.sum() == many.counts.sum() and len(set(many.strings(some).to_pylist())) == len(some)
    monkeypatch.setattr(kneserney, "BLOCK", 100)
    batches = [pa.record_batch([pa.array(texts[i : i + 3])], ["t"]) for i in (0, 3, 6)]
    assert sum((b.column(0).to_pylist() for b in kneserney._blocks(iter(batches))), []) == texts


def test_perplexity_prefers_what_it_saw(spark, docs, empty):
    r = random.Random(0)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, text("abcd") if i < 40 else text("@#$~"), "xx") for i in range(50)] + [(60, None, None), (61, "", "xx")]
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(45, 0)], "doc_id long, quality int")
    out = {r.doc_id: r for r in kneserney.perplexity_verdicts(some, labels).collect()}
    assert len(out) == len(rows)
    assert all(out[i].perplexity > out[0].cut and not out[i].kept for i in range(40, 50))
    assert sum(out[i].kept for i in range(40)) >= 36
    assert kneserney.perplexity_verdicts(empty, labels).count() == 0
    assert kneserney.perplexity_verdicts(some, labels.limit(0)).filter("not kept").count() == 0


# 9


def _components(rows, k, percent):
    sets = defaultdict(list)
    for i, t in rows:
        w = blank_words(t)
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets[i].append(s)
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for a in ids:
        for b in ids:
            if b < a and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sets, {i: find(i) for i in root}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(rows, docs, empty, k, percent):
    sets, root = _components([(r[0], r[1]) for r in rows], k, percent)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=k, percent=percent).collect())
    want = Counter((i, len(s), root.get(i)) for i in sets for s in sets[i])
    assert got == want
    assert minhash.near_duplicates(empty).count() == 0


def test_a_gradient_of_copies_is_linked_exactly(spark):
    """A chain whose ends are unlike, and copies around a centre that aren't alike among themselves."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in r.sample(range(120), i % 9):
            words[j] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    chain = list(base[::-1])
    for i in range(60, 90):
        chain[i - 60] = f"c{i}"
        rows.append((i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, root = _components(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle=3, percent=85).collect()} == root


# 10


def _hashes(words):
    import pyarrow as pa

    _, _, data, off = next(kernels.pieces(pa.array([" ".join(words)])))
    return kernels.Words(data, off, kernels.BLANK_WORDS).hashes().tolist()


def _units_of(text):
    """(start, n_chars, words as text) of the units of a text, by the definition."""
    out, at, size = [], 0, substrings.WINDOW
    for line in text.split("\n"):
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        words = [line[a:b].translate(LOWER) for a, b in spans]
        h = _hashes(words) if words else []
        begins = {min(range(i, i + size), key=lambda j, h=h: (h[j], -j)) for i in range(len(h) - size + 1)}
        begins = sorted(begins | {0}) if words else []
        for i, j in zip(begins, [*begins, len(words)][1:], strict=True) if words else ():
            end = spans[j][0] if j < len(words) else spans[-1][1]
            out.append((at + spans[i][0], end - spans[i][0], " ".join(words[i:j])))
        at += len(line) + 1
    return out


def test_repeated_passages_equal_brute_force(rows, docs, empty):
    for least in (1, 50):
        floor = max(1, least - 2 * substrings.WINDOW + 1)
        distinct = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
        first, want = {}, set()
        for i, t in distinct:
            run = []
            for n, (start, size, unit) in enumerate([*_units_of(t), (0, 0, None)]):
                again = unit is not None and first.setdefault(unit, (i, n)) != (i, n)
                if again:
                    run.append((i, n, start, size, len(unit.split(" "))))
                    continue
                if sum(u[4] for u in run) >= floor:
                    want.update(u[:4] for u in run)
                run = []
        found = substrings.repeated_passages(docs, least_words=least)
        assert {(r.doc_id, r.unit_no, r.start, r.n_chars) for r in found.collect()} == want and want
    texts = {r[0]: r[1] for r in rows}
    for r in substrings.without(docs, found).filter("doc_id is not null").collect():
        if r.text is not None and r.pieces:
            assert r.text == "".join(texts[r.doc_id][p.start : p.start + p.n_chars] for p in r.pieces)
    assert substrings.repeated_passages(empty).count() == 0


def test_a_passage_is_found_wherever_in_a_line_it_stands(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    passage = [word() for _ in range(55)]
    rows = []
    for i in range(30):
        own = [word() for _ in range(200)]
        at = r.randrange(200)
        rows.append((i, " ".join(own[:at] + (passage if i % 2 else []) + own[at:]), "same name"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, unit_no string")
    found = substrings.repeated_passages(docs).groupBy("doc_id").agg({"words": "sum"}).collect()
    assert {f.doc_id for f in found} == set(range(3, 30, 2))
    assert all(55 - 2 * substrings.WINDOW < f["sum(words)"] <= 55 for f in found)


# Kernels


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["Ab cé\x0bd", None, "", "x" * 40 + " " + "x" * 41, "ab Cé D"]
    seen = []
    for start, _, data, off in kernels.pieces(pa.array(texts)):
        w = kernels.Words(data, off, kernels.BLANK_WORDS)
        h = w.hashes()
        seen += [h[w.first[i] : w.first[i + 1]].tolist() for i in range(len(off) - 1)]
        assert start == 0
    assert [len(s) for s in seen] == [len(blank_words(t)) for t in texts]
    assert seen[0] == seen[4] and seen[3][0] != seen[3][1]
