"""Fingerprints, the filter audit and spelling variants against brute force, and on rows that break things."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.functions import rand, spark_partition_id

from tulya.llm import audit, fingerprints, kneserney, spelling
from tulya.llm import kernels as K
from tulya.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, edge int, part string, word string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(n=150, seed=9):
    r = random.Random(seed)
    letters = "abcdeéÉü×"
    stems = ["".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(60)]

    def variant(w):
        i = r.randrange(len(w))
        return r.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :], w[::-1], w.capitalize()])

    rows = []
    for i in range(n):
        lines = [" ".join(variant(r.choice(stems)) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 8))]
        rows.append([i * 2, "\n".join(lines) + r.choice(["", "", " #", " A B C D", "\n"]), r.choice(["xx", "yy", None, ""])])
    for i in range(n, n + 30):
        rows.append([i * 2, rows[r.randrange(n)][1], "xx"])
    odd = [None, "", " \n ", "x", "👍 é", "w " * 4000, "\n".join(["same line"] * 900), "aaaaaa aaaaaa aaaaaa aaaaa aaaaab baaaaa"]
    rows += [[1000 + i, t, None] for i, t in enumerate(odd)]
    long = "abé" * 40
    rows += [[2000, " ".join([long] * 4 + [long[:50] + "z" + long[50:]] * 3 + [long[:-1]] * 9), "zz"]]
    return [(i, t, lang, "s", 7, "p", "q") for i, t, lang in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 13


def test_spelling_equals_brute_force(spark, rows, docs):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if a == b or len(b) - len(a) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, links = {}, {}
    for w in n:
        some = [x for x in n if near(w, x)]
        links[w] = len(some)
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    want = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        want.add((w, form[w], root, n[w], links[w], n[form[w]] if form[w] else None))
    got = spelling.spelling_groups(spelling.counted(spelling.planted(spelling.runs(docs)))).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(links.values()) and any(len(w) > spelling.SHORT and form[w] for w in n) and any(form[form[w]] for w in n if form[w])


def test_spelling_of_odd_tables(spark, empty):
    assert spelling.spelling_groups(spelling.counted(spelling.planted(spelling.runs(empty)))).count() == 0
    words = spark.createDataFrame([(None, 9, 1), ("abcde", 3, 1), ("abcdf", 6, 1), ("abcdg", 6, 1), ("edcba", 99, 1)], "word string, n long, ref int")
    got = {tuple(r) for r in spelling.spelling_groups(words).collect()}
    assert got == {
        ("abcde", "abcdf", "abcdf", 3, 2, 6), ("abcdf", None, "abcdf", 6, 2, None), ("abcdg", None, "abcdg", 6, 2, None), ("edcba", None, "edcba", 99, 0, None),
    }
    nameless = spark.createDataFrame([(None, "abcde Abcde ABCDE")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.counted(spelling.planted(spelling.runs(nameless))).collect()] == [("abcde", 3)]
    with pytest.raises(ValueError):
        spelling.spelling_groups(words, ratio=1)


def test_long_chains_of_forms_end_at_the_last(spark):
    chain = [("a" * i + "b" * (40 - i), 1 << i) for i in range(1, 39)]
    got = {r.word: r.root for r in spelling.spelling_groups(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1][0]}


# 12


def audited(rows, labels):
    """The audit by a set of documents for each step."""
    word = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    docs, first = [], {}
    for i, t, lang, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang, *_ in rows:
        t, w = t or "", word(t or "")
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        mine = [x for x in labels if x[0] == i and i is not None]
        docs.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(stay), len(gone), sum(d[1][f] for d in own) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
                left = stay
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return out


def test_audit_equals_brute_force(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK", 16)  # many blocks and parts inside them
    r = random.Random(1)
    marks = [(i[0], r.randint(0, 1), r.randint(0, 1)) for i in rows[::2]] + [(rows[0][0], 1, 1), (None, 1, 1), (rows[4][0], None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    more = docs.union(spark.createDataFrame([(None, rows[3][1], "xx", "s", 1, "p", "q"), (rows[3][0], rows[3][1], "xx", "s", 1, "p", "q")], SCHEMA))
    flags = audit.text_flags(more, labels)
    got = audit.filter_audit(flags, {x: x.lower() for x in "ABCDE"}, {"good_lost": "good", "toxic_lost": "toxic"}, "part").collect()
    want = audited([*rows, (None, rows[3][1], "xx"), (rows[3][0], rows[3][1], "xx")], marks)
    cells = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(x.part, x.filter_order, x.step): [x[c] for c in cells] for x in got} == want and len(got) == len(want)


def test_audit_of_other_filters_and_odd_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(audit.text_flags(empty, labels), {"A": "a"}, {}, "part").count() == 0
    flags = spark.createDataFrame([(True, None, f"p{i % 40}") for i in range(200)], "x boolean, y boolean, p string")
    got = audit.filter_audit(flags, {"X": "x", "Y": "y"}, {}, "p").collect()
    assert len(got) == 40 * 4 and {(r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got} == {
        ("XY", 1, 0, 5, 0, 5, 10), ("XY", 2, 0, 0, 0, 0, 0), ("YX", 1, 5, 0, 0, 0, 0), ("YX", 2, 0, 5, 0, 5, 10),
    }
    with pytest.raises(ValueError):
        audit.filter_audit(flags, {}, {}, "p")


def test_a_block_of_many_parts_is_small(spark):
    flags = spark.range(5000).selectExpr("id % 3 = 0 as x", "cast(id as string) as p").coalesce(1)
    index = audit.bitmap_index(flags, ["x"], [], "p").collect()
    assert sum(len(p.bits) for r in index for p in r.parts) == 5000


# 11


def pieces(text):
    """Paragraphs by a plain loop: a word with the blanks behind it; lines, hashes and LONGEST end them."""
    raw = text.encode()
    tokens = re.findall(rb"^[ \t-\r]*[^ \t-\r]+[ \t-\r]*|[^ \t-\r]+[ \t-\r]*", raw) or ([raw] if raw else [])
    hashes = []
    if tokens:
        data = np.frombuffer(raw, np.uint8)
        w = K.Words(data, np.array([0, len(raw)]), K.BLANK_WORDS, lower=False)
        at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        w.starts, w.ends = at[:-1], at[1:]
        hashes = w.hashes().tolist()
    out, now = [], []
    for t, h in zip(tokens, hashes):
        now.append(t)
        if b"\n" in t or h % 4 == 0 or len(now) == fingerprints.LONGEST:
            out.append(b"".join(now))
            now = []
    return Counter([*out, b"".join(now)] if now else out)


def jaccard(a, b):
    every = (a | b).total()
    return (a & b).total() / every if every else 1.0


def test_fingerprints_equal_brute_force(spark, rows, docs):
    got = {r.doc_id: r for r in fingerprints.with_next(docs).collect()}
    texts = [(i, t or "") for i, t, *_ in sorted(rows, key=lambda r: r[0])]
    assert len(got) == len(texts)
    for (i, t), (_, follows) in zip(texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + follows[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(pieces(t), pieces(edited))) and r.near_next == pytest.approx(jaccard(pieces(t), pieces(follows)))
        assert [r.fingerprint, r.edited_fingerprint] == fingerprints.fingerprint([t, edited])
    prints = {}
    for i, t in texts:
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert len(set(prints.values())) == len(prints)
    assert {len(base64.b64decode(p)) for p in prints.values()} == {12 + 3 * 8 * 12}


def test_fingerprints_of_odd_tables(spark, empty):
    assert fingerprints.with_next(empty).count() == 0
    alone = fingerprints.with_next(spark.createDataFrame([("a", "one two\nthree", 1)], "doc_id string, text string, part int")).collect()
    assert [(r.doc_id, r.near_edited, r.near_next) for r in alone][0][::2] == ("a", 1.0)
    same = spark.createDataFrame([(1, "x y")] * 300 + [(None, None), (2, "p q")], "doc_id int, text string").repartition(7)
    got = fingerprints.with_next(same).collect()
    assert len(got) == 302 and sum(r.near_next == 1 for r in got) == 299


def test_peeling_recovers_differences_and_reports_failure():
    r = np.random.default_rng(3)
    shared, one, two = (r.integers(1, 1 << 63, n).astype(np.uint64) for n in (5000, 5, 4))
    sketch = lambda d, cells: fingerprints.Sketches.of(1, np.zeros(len(d), np.int64), d, cells)
    left = sketch(np.concatenate([shared, one]), 16).minus(sketch(np.concatenate([two, shared]), 16))
    done, row, digest, sign = left.peel()
    assert done.all() and set(digest[sign > 0]) == set(one) and set(digest[sign < 0]) == set(two)
    assert not sketch(shared, 16).peel()[0].any()


def test_fingerprint_query_reads_all(spark, rows, docs):
    path = new_path(spark, "t")
    docs.write.parquet(f"{path}/documents.parquet")
    assert fingerprints.op11(spark, path).columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert spelling.op13(spark, path).columns == ["word", "form", "root", "n", "n_near", "form_n"]


# 8


def test_perplexity_of_rows_that_come_in_another_order_each_time(spark, docs, monkeypatch):
    monkeypatch.setattr(kneserney, "BLOCK", 20_000)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 4)], "doc_id long, quality int")
    shuffled = docs.select("*", spark_partition_id().alias("p")).orderBy(rand()).drop("p")
    some = {r.doc_id: round(r.perplexity, 9) for r in kneserney.perplexity_verdicts(docs, labels).collect()}
    assert {r.doc_id: round(r.perplexity, 9) for r in kneserney.perplexity_verdicts(shuffled, labels).collect()} == some
