"""License scans, filter audit and hard negatives against plain versions."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import filter_audit, hard_negatives, license_scan
from panelwright.llm.license_templates import MIT_PERMISSION, TEMPLATES


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_words_are_those_of_the_pattern():
    for t in ["", " ", "A-b c", "É9 x y Z", "-", "x" * 10 + " ," * 7, "ß.ſ", "a\x7fb\x00c"]:
        assert [w.decode() for w in license_scan.spaced(t.encode()).split(b" ") if w] == plain_words(t)


@pytest.mark.parametrize("size", [1, 7])
def test_slices_of_long_texts(monkeypatch, size):
    monkeypatch.setattr(license_scan, "SLICE", size)
    t = "Ab  c-d,,  e " * 50
    assert license_scan.spaced(t.encode()) == b" " + " ".join(plain_words(t)).encode() + b" "


def as_regex(template):
    """The template as a regular expression over words, each followed by a space."""
    out, at = "", 0
    for m in [*license_scan.MARK.finditer(template), None]:
        out += "".join(re.escape(w) + " " for w in plain_words(template[at : m.start() if m else None]))
        if m:
            at = m.end()
            out += "(?:" if m[1] == "beginOptional" else ")?" if m[1] == "endOptional" else "(?:[^ ]+ ){%s,%s}" % (m[2], m[3])
    return out


def test_automata_equal_regular_expressions():
    r = random.Random(3)
    templates = ["a <<beginOptional>>b <<beginOptional>>c<<endOptional>> a<<endOptional>> <<var;words=0..2>> b", "b a<<beginOptional>> c<<endOptional>>", "c <<var;words=1..3>> c", "a b c a b c"]
    for template in templates:
        automaton, pattern = license_scan.Automaton(template), re.compile(as_regex(template))
        for _ in range(300):
            words = [r.choice("abcd") for _ in range(r.randint(0, 14))]
            text = b" " + b"".join(w.encode() + b" " for w in words)
            joined = text.decode()[1:]
            for i in range(len(words)):
                best = next((n for n in range(len(words) - i, 0, -1) if pattern.fullmatch(" ".join(words[i : i + n]) + " ")), None)
                got = automaton.longest(text, 2 * i)
                assert (got and got[0]) == best, (template, joined, i)
                if best:
                    scanner = license_scan.Scanner({"x": [template]}, {})
                    assert 2 * i in scanner.starts(text).get(0, [])


def test_bad_templates_are_refused():
    for template in ["<<var;words=0..2>> a", "<<beginOptional>>a<<endOptional>>", "a <<beginOptional>> b", ""]:
        with pytest.raises(ValueError):
            license_scan.Automaton(template)


def test_only_whole_mandatory_wording_is_accepted():
    scanner = license_scan.Scanner(TEMPLATES, {})
    full = re.sub(r"<<var[^>]*>>", "the authors or copyright holders", re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", MIT_PERMISSION)) + " NONINFRINGEMENT"
    full = re.sub(r"PURPOSE AND\s+\.", "PURPOSE AND NONINFRINGEMENT.", full)
    assert [p[0] for p in scanner.places("Copyright me. " + full)[1]] == ["mit"]
    for word in ("hereby", "sublicense", "merchantability", "dealings"):
        assert not scanner.places(re.sub(word, "x", full, flags=re.I))[1]
    assert not scanner.places(full.replace("the authors or copyright holders", "z " * 21))[1]
    assert [p[0] for p in scanner.places(full.replace("this permission notice", "this permission notice (including the next paragraph)"))[1]] == ["mit"]


def test_license_scan_against_brute_force(spark):
    r = random.Random(7)
    vocabulary = ["Under", "the", "MIT", "license", "apache", "version", "2", "CC", "by", "nc", "licensed", "4", "0", "é"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 300)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "--"), (93, "under the mit license " * 3), (93, "under the mit license " * 3), (None, "CC-BY:NC Released under the MIT License, ok")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, labels string, n_words int, places int")
    got = sorted(map(tuple, license_scan.summary(license_scan.scan(docs)).collect()), key=str)
    phrases = {k: plain_words(p) for k, p in license_scan.PHRASES.items()}
    patterns = [(k, re.compile(as_regex(t))) for k, ts in TEMPLATES.items() for t in ts]
    want = []
    for i, t in rows:
        w = plain_words(t)
        base = [(k, j, len(p)) for k, p in phrases.items() for j in range(len(w)) if w[j : j + len(p)] == p]
        more = []
        for k, pattern in patterns:
            j = 0
            while j < len(w):
                n = next((n for n in range(min(40, len(w) - j), 0, -1) if pattern.fullmatch(" ".join(w[j : j + n]) + " ")), 0)
                more += [(k, j, n)] if n else []
                j += n or 1
        starts = [j for _, j, _ in base]
        covered = {x for _, j, n in base + more for x in range(j, j + n)}
        want.append((i, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for k, _, _ in base})), ",".join(sorted({k for k, _, _ in base + more})), len(covered) / max(1, len(w))))
    assert got == sorted(want, key=str)
    assert license_scan.summary(license_scan.scan(docs.limit(0))).count() == 0


def test_license_scan_of_long_repeats():
    scanner, began = license_scan.Scanner(TEMPLATES, license_scan.PHRASES), time.process_time()
    for unit in ("under the mit ", "licensed under a creative commons attribution ", "permission is hereby granted ", "under the mit license "):
        scanner.places(unit * 200_000)
    assert time.process_time() - began < 60


def audit_rows(spark, rows, marks):
    docs = spark.createDataFrame([(i, t, p, 1, True) for i, t, p in rows], "doc_id long, text string, lang string, mask int, first boolean")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    return filter_audit.audit(docs, labels, filter_audit.text_filters(docs["text"]))


def test_filter_audit_against_runs_of_every_order(spark):
    r = random.Random(5)
    texts = [None, "", "a b a a a", "ABC DEF", "x $ y", " ".join(map(str, range(120))), " ".join(map(str, range(120))) + " $", "Q" * 50 + " " + " ".join(map(str, range(130))), " \t ", "w " * 200]
    rows = [(i if i % 9 else None, r.choice(texts), r.choice(["en", None, "", "de"])) for i in range(150)] + [(7, texts[2], "en"), (7, texts[2], "en"), (8, "only", "fr")]
    marks = [(r.randrange(150), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1)]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    fails = {
        "A": lambda i, t: len(words(t)) < 100,
        "B": lambda i, t: 100 * len(set(words(t))) < 80 * len(words(t)),
        "C": lambda i, t: 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
        "D": lambda i, t: bool(re.search("[#$%&*|]", t)),
        "E": lambda i, t: i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
    }
    good, toxic = {i for i, q, _ in marks if i is not None and q == 1}, {i for i, _, x in marks if i is not None and x == 1}
    want, removed_by = {}, Counter()
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    judged = [(p or "", i, {f for f in fails if fails[f](i, t or "")}) for i, t, p in rows]
    for part in {p for p, _, _ in judged}:
        for order in orders:
            left, gone = [(i, f) for p, i, f in judged if p == part], []
            for step, f in enumerate(order, 1):
                out, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                want[part, order, step] = [len(left), len(out), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in out + gone), sum(x[0] in good for x in out), sum(x[0] in toxic for x in out)]
                gone += out
                removed_by[part, f] += len(out)
    got = {(x.part, x.filter_order, x.step): list(x)[3:] for x in audit_rows(spark, rows, marks).collect()}
    assert got == {k: [*v, removed_by[k[0], k[1][k[2] - 1]]] for k, v in want.items()}


def test_filter_audit_of_empty_tables(spark):
    assert audit_rows(spark, [], []).count() == 0
    one = audit_rows(spark, [(None, None, None)], []).where("step = 5").first()
    assert (one.part, one.kept, one.shapley) == ("", 0, 120 if one.filter_order.endswith("A") else 0)


def plain_hard_negatives(rows, k=5):
    rows = [(i, lab, np.floor(256 * np.float64(v)).astype(int)) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    pad = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, lab, np.pad(v, (0, pad - len(v)))) for i, lab, v in rows]
    last = lambda i: (i is None, i or 0)
    out = []
    for key in {(i, lab, tuple(v)) for i, lab, v in rows if i is not None and i % 10 == 0}:
        a, lab, v = key
        scored = sorted(((-int(np.dot(v, w)), *last(i), i, m) for i, m, w in rows if i != a), key=lambda x: x[:3])
        for p in [x for x in scored if x[4] == lab][:k]:
            fit = [x for x in scored if x[4] != lab and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]][:k]
            out += [(a, p[3], n, x[3], -p[0], -x[0]) for n, x in enumerate(fit, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["normal", "ties", "outliers", "ragged"])
def test_hard_negatives_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "ROWS_A_BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 16)
    monkeypatch.setattr(hard_negatives, "FEWEST_ROWS", 80)
    g = np.random.default_rng(1)
    values = {"normal": lambda: g.normal(size=6), "ties": lambda: g.integers(-1, 2, size=3), "outliers": lambda: g.normal(size=6) * (1e6 if g.random() < 0.02 else 0.1), "ragged": lambda: g.normal(size=g.integers(0, 6))}[kind]
    rows = [(i, int(g.integers(0, 3)) if i % 3 else 0, [float(x) for x in values()]) for i in range(230)]
    rows += [(1000, None, [1.0, 2.0]), (1001, 1, None), (1002, 1, [1.0, None]), (1010, 1, [float("nan")]), (1020, 0, [float("inf")]), (None, 1, rows[3][2]), (40, rows[40][1], rows[40][2]), rows[13], (1030, 77, [0.5])]
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, label int, embedding array<float>, score int, id int").repartition(3)
    rows = [(i, lab, v and [x if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    from pyspark.sql import functions as F

    got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == plain_hard_negatives(rows)


def test_hard_negatives_of_few_rows(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    for table in (one.limit(0), one):
        assert hard_negatives.mine(table, F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold_every_score():
    g = np.random.default_rng(2)
    for scale in (1, 1000):
        q, a = g.integers(-scale, scale + 1, size=(500, 9)), g.integers(-scale, scale + 1, size=(7, 9))
        b = hard_negatives.block(np.arange(500), g.integers(0, 4, 500), q)
        low, high = hard_negatives.bounds(b, slice(100, 400), a)
        exact = b["q"][100:400].astype(int) @ a.T
        assert (low <= exact).all() and (exact <= high).all()
        assert scale > 1 or (low == high).all()
