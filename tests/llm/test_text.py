import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, html_extract, language, pii, storage, url_filter, warc
from panelwright.llm.dom import MAX_DEPTH, Tree
from panelwright.llm.labelled_pages import page


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_hit string, contaminated int")


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_WINDOWS, 3])
def test_decontamination_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["a", "b", "c", "É", "é1"]) for _ in range(n))
    items = [(1, text(14)), (2, "Q-q q"), (3, None), (4, "!!"), (12, text(10)), (None, "a a")]
    rows = [(i, text(r.randint(0, 200))) for i in range(60)] + [(70, items[0][1].upper() + "! x"), (71, None), (72, ""), (73, "q,q;q q")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = [(str(i), w[k : k + 10]) for i, t in items if i and (w := plain_words(t)) for k in range(max(1, len(w) - 9))]
    got = {x.doc_id: x for x in decontaminate.contamination(docs(spark, rows), bench).collect()}
    for i, t in rows:
        w, hit, found = plain_words(t), set(), set()
        for name, g in grams:
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    found.add(name)
        x = got[i]
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert x.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    clean = decontaminate.remove_contaminated(docs(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, x in got.items() if not x.contaminated} and clean.columns == docs(spark, rows).columns


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = decontaminate.remove_spans(docs(spark, [(1, "Say: One, two three! ok"), (2, "one two")]), bench).collect()
    assert {r.doc_id: r.text for r in got} == {1: "Say: ,  ! ok", 2: "one two"}
    empty = bench.limit(0)
    assert decontaminate.contamination(docs(spark, [(1, "a")]), empty).first().n_hit == 0


def test_a_window_of_many_items_and_documents(spark, monkeypatch):
    """A third of the documents hold one window that all items share: no join sends them to one task, nor the items to one row."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 1)
    shared = "all items have these ten words in the very same order"
    bench = spark.createDataFrame([(i, f"{shared} and tail {i}") for i in range(60)], "item_id long, text string")
    table = docs(spark, [(i, shared if i % 3 == 0 else f"clean text {i}") for i in range(900)])
    got = decontaminate.contamination(table, bench).collect()
    assert {(r.n_hit, r.n_items) for r in got if r.doc_id % 3 == 0} <= {(11, 60), (10, 60)} and all(r.n_hit == 0 for r in got if r.doc_id % 3)
    found = spark.createDataFrame([(i, bytes([i % 251]), b"w") for i in range(300)], "h_doc long, h_key binary, window binary")
    few = spark.createDataFrame([(b"w", str(i)) for i in range(3)], "window binary, item_id string")
    tasks = decontaminate._salted(found, few.select("window").distinct(), "window", ["h_doc"]).select("h_doc", F.pmod(F.xxhash64("h_doc"), F.lit(decontaminate.SALTS)).alias("salt")).groupBy("salt").count().collect()
    assert max(r["count"] for r in tasks) < 300 / 4 and decontaminate._items_of(found, few, ["h_doc", "h_key"]).count() == 900


def test_the_broadcast_is_bounded_by_bytes(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "w" * 3000)], "item_id long, text string")
    assert len(decontaminate.small_windows(bench)) == 1 and decontaminate.small_windows(bench.limit(0)) == []
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 2000)
    assert decontaminate.small_windows(bench) is None


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_WINDOWS, 1])
def test_cleaning_with_null_and_repeated_ids(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    bench = spark.createDataFrame([(1, "one two three"), (2, "two three four"), (3, "x y")], "item_id long, text string")
    rows = [(None, "Say: One, two three! four ok"), (None, "fine"), (5, "a X/y b"), (5, "clean"), (5, "a X/y b"), (6, None), (None, None)]
    table = docs(spark, rows).selectExpr("*", "1 AS h_doc", "2 AS h_key", "3 AS h_spans", "4 AS window", "5 AS salt", "6 AS at")
    clean = decontaminate.remove_contaminated(table, bench)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([rows[i] for i in (1, 3, 5, 6)], key=str) and clean.schema == table.schema
    cut = decontaminate.remove_spans(table, bench)
    want = [(None, "Say: ,  !  ok"), rows[1], (5, "a / b"), rows[3], (5, "a / b"), rows[5], rows[6]]
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted(want, key=str) and cut.columns == table.columns
    judged = [(r.doc_id, r.n_hit, r.n_items) for r in decontaminate.contamination(table, bench).collect()]
    assert sorted(judged, key=str) == sorted([(None, 4, 2), (None, 0, 0), (5, 2, 1), (5, 0, 0), (5, 2, 1), (6, 0, 0), (None, 0, 0)], key=str)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b", "x"), (5, None, "x"), (3, "u", None), (4, "u", ""), (9, "u", "é" * 5000), (None, "n", "x"), (None, "n", "only"), (2, "u", "x")]
    pages = spark.createDataFrame([(a, b, c, "r") for a, b, c in rows], "page_id long, url string, html string, record_type string")
    folder = storage.scratch(spark, "arc")
    got = {(r.page_id, r.payload_digest): r for r in warc.read_warc(warc.convert(warc.write_arc(pages.repartition(3), folder), folder)).collect()}
    sha = lambda t: warc.digest32(hashlib.sha1(t.encode()).digest())
    assert len(got) == len(rows)
    assert {p: got[p, sha("x")].record_type for p in (1, 5, 2, None)} == {1: "revisit", 5: "response", 2: "revisit", None: "revisit"}
    assert got[3, sha("")].record_type == "revisit" and got[4, sha("")].record_type == "response" and got[None, sha("only")].record_type == "response"
    assert got[1, sha("x")].refers_id == warc.record_id(5, "") and got[9, sha("é" * 5000)].payload_bytes == 10000


def test_arc_versions_and_bad_lengths():
    for version in (1, 2):
        fields = warc.arc_fields(warc.arc_header(version, "f", "20240101000000"))
        assert warc.parse_arc(warc.arc_record(version, "http://x", "20240101000000", b"HTTP\r\n\r\nab", "f", 7), fields)[1] == b"HTTP\r\n\r\nab"
        with pytest.raises(ValueError):
            warc.parse_arc(b"http://x 1 2 3 200 - - 0 f 99\nshort" if version == 2 else b"http://x 1 2 3 99\nshort", fields)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", ["plain", "whole", "records"])
def test_foreign_arc_files(spark, tmp_path, version, packed):
    """Records without a member each are told apart by their declared lengths alone, even where a block looks like a record line."""
    date, page = "20010203040506", b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\nhttp://fake 1.2.3.4 20010203040506 text/html 5\n12345\n\n"
    records = [warc.arc_header(version, "old.arc", date), *(warc.arc_record(version, u, date, b, "old.arc", 0) for u, b in [("http://a/", page), ("dns:a", b"20010203\na. 1 IN A 1.2.3.4\n"), ("http://b/", page), ("http://c/", b"HTTP/1.0 200 OK\r\n\r\n"), ("ftp://d/x", b"plain text")])]
    data = {"plain": b"".join(records), "whole": warc.member(b"".join(records)), "records": b"".join(map(warc.member, records))}[packed]
    (tmp_path / "old.arc").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/old.arc",)], "path string")
    out = warc.convert(files, storage.scratch(spark, "foreign"))
    got = {r.url: r for r in warc.read_warc(out).collect()}
    assert {u: r.record_type for u, r in got.items()} == {"http://a/": "response", "http://b/": "response", "http://c/": "response", "dns:a": "resource", "ftp://d/x": "resource"}
    assert got["http://a/"].payload_bytes == len(page.partition(b"\r\n\r\n")[2]) and got["dns:a"].payload_bytes == 27
    raw = b"".join(d for _, _, d in warc.members(out.first()[0]))
    assert raw.count(b"WARC-Type: warcinfo") == 1 and f"arc-version: {version}".encode() in raw and b"2001-02-03T04:05:06Z" in raw and b"text/dns" in raw


def test_warc_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = storage.scratch(spark, "arc")
    assert warc.read_warc(warc.convert(warc.write_arc(pages, folder), folder)).count() == 0


def test_a_failed_file_leaves_nothing(tmp_path):
    with pytest.raises(RuntimeError), storage.AtomicFile(f"file://{tmp_path}", "x") as out:
        out.write(b"half")
        raise RuntimeError
    assert list(tmp_path.iterdir()) == []


def luhn(x):
    d = [int(c) for c in x if c.isdigit()][::-1]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0


def base_spans(t):
    digits = lambda m: sum(c.isdigit() for c in m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= digits(m) <= 19 and luhn(m[0])), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= digits(m) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t or "") if ok(m)]


def test_pii_against_plain_patterns(spark):
    r = random.Random(3)
    rows = [None, "", "a@b.c_d@e.f.g@h.i", "1.2.3.4.5.6.7.8 999.1.2.3.4 00255.1.1.001", "+1 (407) 555-7710 +49--- 12345678-90", "🎉 x@y.z 4111 1111 1111 1111, 4111-1111-1111-1112", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "1." * 3000, "a" * 3000 + "@"]
    rows += ["".join(r.choice("01 +.-()@ab.c4_é🎉") for _ in range(r.randint(5, 70))) for _ in range(500)]
    got = {x.doc_id: x for x in pii.find_pii(docs(spark, list(enumerate(rows)))).collect()}
    for i, t in enumerate(rows):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert got[i].n_email == sum(w.startswith("email") for w in want) and set(want) <= set(got[i].spans.split(","))
    assert "secret:9:49" in got[6].spans
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_estimate_tells_labelers_apart():
    counts = [(0, "2222", 500), (0, "2211", 80), (0, "0000", 400), (0, "2000", 60), (0, "0222", 50)]
    p = pii.estimate(counts)
    assert p[0, "2222"] > 0.9 and p[0, "0000"] < 0.1 and p[0, "0222"] > p[0, "2000"]


def test_url_rules_and_models(spark):
    urls = [f"http://a{i}.good.net/x" for i in range(40)] + [f"https://B{i}.Fine.org/fr/y?q" for i in range(40)] + [None, "no scheme", "http://x.org/en/", "http://net/", "http://net", "http://example.net/en/1#t", "http://www.example.com/de/2", "http://anet/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(urls) and (got[45].rule, got[45].verdict, got[45].host, got[45].path) == ("org/fr/", "allow", "b5.fine.org", "/fr/y")
    assert (got[0].rule, got[0].verdict) == ("net/", "block") and got[80].host == "" and got[81].rule is None
    assert got[83].rule == "net/" and got[84].rule is None and got[85].rule == "example.net/en/" and got[86].rule == "example.com/de/" and got[87].rule is None
    assert got[82].verdict == "allow" and all(r.verdict in ("allow", "block") for r in got.values())


def test_html_extraction(spark):
    model = html_extract.train(150, 100)
    right = 0
    for seed in range(9000, 9060):
        nodes = Tree(page(seed)).nodes
        y = html_extract.labels_of(nodes)
        p, _ = html_extract.Forest([nodes]).marginals(*model)
        right += all((p[i, 1] > 0.5) == y[i] for i, n in enumerate(nodes) if n.tag == "text")
    assert right >= 50
    html = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three four five six.</p></article><div class=comments><p>I say this.</p></div><footer>&copy; me</footer>"
    pages = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(pages, model).collect()}
    assert got[1].text == "A & B\n\nOne two.\n\nThree four five six." and got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == ""
    assert html_extract.extract(pages.limit(0), model).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<head><title>t</title><body><p>One.</p>", "One."),
        ("<head><title>t</title><meta x><p>One.</p></body>", "One."),
        ("<head><title>t</title>One.", "One."),
        ("<head><noscript></noscript><style>p{}</style></head><p>One.", "One."),
        ("<head><title>t</title><svg><path/></svg><div>One.</div>", "One."),
        *((f"<div><p>One.</p><{t}>in</div><div>Two.</div></body>", "One. in Two.") for t in ("button", "select", "map", "video", "svg")),
        ("<ul><li>One.<button>in</li><li>Two.<button>x</button></li></ul>", "One.in Two."),
        ("<div><button>in</div><p>One.</p><div></button>Two.</div>", "One. Two."),
        ("<div><button><div>in</div>x</button>One.</div><select><option>x</select>Two.", "One. Two."),
        ("<article><p>Let <math><mi>x</mi></math> be.</p><object>One.</object><noscript><p>Two.</p></noscript></article>", "Let x be. One. Two."),
    ],
)
def test_unclosed_elements_swallow_no_text(html, want):
    assert " ".join(n.text for n in Tree(html).nodes if n.tag == "text") == want


@pytest.mark.parametrize("tag", ["div", "span", "li", "a", "p", "svg", "b", "button", "template", "table"])
def test_pages_of_very_many_open_elements(tag):
    began = time.process_time()
    nodes = Tree(f"<article>{f'<{tag}>' * 200_000}One.</article><p>Two.").nodes
    assert {"One.", "Two."} & {n.text for n in nodes} and max(n.depth for n in nodes) <= MAX_DEPTH
    w = (np.zeros(html_extract.N_FEATURES), np.zeros((len(html_extract.EDGES), 2, 2)))
    html_extract.Forest([nodes]).marginals(*w)
    assert time.process_time() - began < 60


@pytest.mark.parametrize("unit", ["<div ", '<a b="', "<a b='", '<a b=">" ', "<a b=<a b=", "</div ", "<!", "<!-- ", "<![CDATA[ ", "<?x ", "<", "< a", "&", "&#", "<p x='\"'"])
@pytest.mark.parametrize("tail", ["", '"', "<p>Two.</p>", "'>\"<!--"])
def test_markup_that_never_ends(unit, tail):
    """In linear time: 200,000 tags, quotes and comments without an end, and the text before them stays."""
    began = time.process_time()
    nodes = Tree("<p>One.</p>" + unit * 200_000 + tail).nodes
    assert "One." in {n.text for n in nodes} and time.process_time() - began < 20


def test_text_around_tags_without_an_end():
    texts = lambda html: [n.text for n in Tree(html).nodes if n.tag == "text"]
    assert texts("<p>One.</p><p>Two <b") == ["One.", "Two <b"] and texts("<p>a &amp; b") == ["a & b"]
    assert texts('<p>One.</p><a href="x>Two.</a><p>Three.') == ["One.", '<a href="x>Two.', "Three."]
    assert texts("<p>One.<script>a<b") == ["One."] and texts("no tags &lt;") == ["no tags <"]


PROSE = "The committee met on Tuesday to discuss the new harbour plans, which have been delayed twice. Members said the cost had risen by a third since spring."
FOREIGN = [
 ("<html><head><title>x</title></head><body><div class='pg'><div class='strip'><a href='/'>Daily Post</a> <a href='/w'>World</a> <a href='/s'>Sport</a></div><div class='lede'><h1>Harbour plan delayed</h1><p>%s</p><p>%s</p><p>Short close.</p></div><div class='xlinks'><ul><li><a href='/1'>One story</a></li><li><a href='/2'>Two story</a></li><li><a href='/3'>Three</a></li></ul></div><div class='end'><a href='/t'>Terms</a> | <a href='/p'>Imprint</a></div></div></body></html>"% (PROSE, PROSE), ["Harbour plan delayed", PROSE, PROSE,"Short close."]),
 ("<body><table><tr><td><a href=a>Index</a><br><a href=b>Next</a><br><a href=c>Prev</a></td><td><h2>Chapter 4</h2>%s<p>%s<ul><li>First point of the list here.</li><li>Second point of the list here.</li></ul></td></tr></table><hr><font size=1><a href=m>Mail the author</a></font></body>"% (PROSE, PROSE), ["Chapter 4", PROSE, PROSE,"First point of the list here.","Second point of the list here."]),
 ("<body><header><a href=/>Site</a><nav><a href=1>A</a><a href=2>B</a></nav></header><main><section><h1>Guide</h1><p>%s</p><pre>code x = 1</pre><blockquote>%s</blockquote></section></main><section id='disqus_thread'><p>I think this is wrong, said a reader. Very wrong.</p></section><footer><p>All rights reserved 2021.</p></footer></body>"% (PROSE, PROSE), ["Guide", PROSE, "code x = 1", PROSE]),
 ("<body><div id=c1><div id=c2><div id=c3><p>%s</p><p>%s</p></div></div></div><form action=/s><input name=q><p>Search our archive of pages.</p></form><aside><h3>Latest</h3><a href=1>One</a><a href=2>Two</a></aside></body>"% (PROSE, PROSE), [PROSE, PROSE]),
]


def test_pages_of_foreign_templates():
    """Templates and class names that the training pages don't have."""
    model = html_extract.train()
    assert [t.split("\n\n") for t in html_extract.extract_many([h for h, _ in FOREIGN], model)] == [w for _, w in FOREIGN]


def test_an_unclosed_comment_ends_the_page():
    assert [n.text for n in Tree("<p>One.</p><script>x = '<!--'</script><p>Two.<!-- three").nodes if n.tag == "text"] == ["One.", "Two."]


def test_messages_equal_enumeration():
    import itertools

    nodes = Tree("<div><p>one</p><div>two<p>three</p></div></div>").nodes
    forest, rng = html_extract.Forest([nodes]), np.random.default_rng(0)
    w, pair = rng.normal(size=html_extract.N_FEATURES), rng.normal(size=(len(html_extract.EDGES), 2, 2))
    own = [w[ids].sum() for ids in np.split(forest.ids, np.cumsum(forest.counts)[:-1])]
    mass = np.zeros((len(nodes), 2))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        e = np.exp(sum(o * v for o, v in zip(own, y, strict=True)) + sum(pair[forest.kind[i], y[nodes[i].parent], y[i]] for i in range(1, len(nodes))))
        for i, v in enumerate(y):
            mass[i, v] += e
    assert np.allclose(forest.marginals(w, pair)[0], mass / mass.sum(axis=1, keepdims=True))


def test_language(spark):
    r = random.Random(1)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(2)) for _ in range(40))
    kinds = {"aa": ["tion", "ing", "the", "wh"], "bb": ["eau", "oux", "ère", "que"]}
    rows = [(i, make(kinds[lang]), lang) for i in range(200) for lang in [sorted(kinds)[i % 2]]] + [(900, None, "aa"), (901, "123 !!", "aa"), (902, "quequeeaux", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.predict(d, language.fit(language.learned_rows(d))).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:200]) and got[900].lang_pred == got[901].lang_pred == "und"
    assert got[902].lang_pred == "bb" and 0 <= got[902].score <= 1 and 20 < sum(x.held_out for x in got.values()) < 80
    none = language.predict(d, language.fit(d.limit(0))).collect()
    assert {x.lang_pred for x in none} == {"und"}


def plain_language(rows, text):
    """Words first, then n-grams from five down, over plain counts; (language, score) as the model should give them."""
    langs = sorted({lang for _, _, lang in rows})
    cut = lambda t: re.findall("[a-z\x80-\U0010ffff]+", t.lower())
    grams = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    counts = {lang: Counter(w for t in {t for _, t, x in rows if x == lang} for w in cut(t)) for lang in langs}
    by_gram = {lang: Counter() for lang in langs}
    for lang in langs:
        for w, k in counts[lang].items():
            for n in range(1, 6):
                for g in grams(w, n):
                    by_gram[lang][g] += k

    def table(counted):
        keys = set().union(*counted.values())
        logs = {k: [math.log((counted[x][k] + 0.1) / (sum(counted[x].values()) + 0.1 * len(keys) + 1)) for x in langs] for k in keys}
        return {k: [v - sum(row) / len(row) for v in row] for k, row in logs.items()}

    known, known_grams = table(counts), table(by_gram)
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    found = []
    for w in cut(text):
        row = known.get(w)
        for n in range(5, 0, -1):
            if row is None and (some := [known_grams[g] for g in grams(w, n) if g in known_grams]):
                row = [sum(c) / len(c) for c in zip(*some, strict=True)]
        found.append(row or [0.0] * len(langs))
    z = [min(len(found), 20) * sum(c) / len(c) for c in zip(*found, strict=True)]
    p = [math.exp(v - max(z)) for v in z]
    return langs[p.index(max(p))], max(p) / sum(p)


def test_language_against_plain_counts(spark):
    r = random.Random(12)
    kinds = {"aa": ["tion", "ing", "the", "wh"], "bb": ["eau", "oux", "ère", "que"], "cc": ["ung", "ing", "sch", "the"]}
    make = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, make(kinds[lang], r.randint(1, 30)), lang) for i in range(200) for lang in [sorted(kinds)[i % 3]]]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)]  # repeated texts count once
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(d)
    asked = [t for _, t, _ in rows[:60]] + [make(["zz", "qq", "ing", "é", "x1"], r.randint(1, 25)) for _ in range(60)] + ["zzz", "— … —", "Ünï", None, "", "12", "日本", "thE-ING,WH"]
    got = language.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    for x in got:
        want = plain_language(rows, asked[x.doc_id])
        assert x.lang_pred == want[0] and abs(x.score - want[1]) < 1e-4, (asked[x.doc_id], want, x)


def test_language_ties_go_to_the_first(spark):
    d = spark.createDataFrame([(1, "same words here", "bb"), (2, "same words here", "aa")], "doc_id long, text string, lang string")
    got = language.predict(d, language.fit(d)).collect()
    assert [(x.lang_pred, x.score) for x in got] == [("aa", 0.5)] * 2
    assert language.predict(d.limit(0), language.fit(d)).count() == 0
    assert language.keep_identified(d.withColumn("score", d.doc_id), language.fit(d)).columns == ["doc_id", "text", "lang", "score"]


def test_pii_candidates_against_a_plain_version(spark):
    r = random.Random(7)
    bits = ["ann (at) site (dot) com", "a.b@c.de", "2001:db8:0:0:0:0:0:1", "4111/1111/1111/1111", "4111_1111_1111_1112", "407-555-7710", "+1 407 555 7710", "24be64439e3e49cf46b2", "word", "x" * 25, "1.2.3.4", " ", "-", "@b.c", "4111 1111 1111 1111"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", ", "]) for _ in range(r.randint(0, 12))) for _ in range(300)] + [None, ""]
    got = {x.doc_id: x for x in pii.candidates(docs(spark, list(enumerate(texts)))).collect()}
    digits = lambda v: sum(c.isdigit() for c in v)
    ok = {
        "card": lambda v: 13 <= digits(v) <= 19 and luhn(v), "phone": lambda v: 9 <= digits(v) <= 15,
        "secret": lambda v: digits(v) > 0 and any(c.isascii() and c.isalpha() for c in v),
    }
    for i, t in enumerate(texts):
        base = [tuple(map(int, x.split(":")[1:])) for x in base_spans(t)]
        want = []
        for kind, pattern in pii.WIDER.items():
            for m in re.finditer(pattern, t or ""):
                if ok.get(kind, lambda v: True)(m[0]) and not any(s < m.end() and m.start() < e for s, e in base):
                    want.append((pii.KINDS.index(kind), m.start(), m.end(), m[0]))
        assert sorted(tuple(x) for x in got[i].wider) == sorted(want), t
        assert [(x.s, x.e) for x in got[i].base] == base


def test_pii_of_a_text_with_very_many_matches(spark):
    """Grows with the text, not with the square of its matches."""
    many = "a@b.co, 24be64439e3e49cf46b2d7c90f3602a3d0b907ff " * 100_000
    began = time.time()
    got = pii.candidates(docs(spark, [(1, many)])).selectExpr("size(base) AS b", "size(wider) AS w", "wider[99999].s AS s").first()
    assert (got.b, got.w, got.s) == (100_000, 100_000, 99_999 * 49 + 8) and time.time() - began < 60


def test_pii_of_long_repeats_of_every_part(spark):
    """No pattern recurses once a repeat, and none grows with the square of the text."""
    parts = ["b (dot) ", "b.", "a@b.", "(at) ", "a[at]", "1", "1 ", "1.", "1.1.1.", "1:", "a1:", "1111/", "1111_", "(111) ", "111-", "+", "+1", "+1 (", "x", "x1", "x-", "id ", "http", "card ", "@", "%+", "é", "a\n"]
    heads = ["", "a (at) ", "a@b.c ", "+1", "4111/4111/4111/4111", "a1"]
    texts = [h + p * 3_000 for p in parts for h in heads] + ["a (at) " + "b (dot) " * 100_000, "a1" + "1" * 100_000]
    began = time.time()
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, list(enumerate(texts))).repartition(8)).collect()}
    assert len(got) == len(texts) and time.time() - began < 120
    assert f"email:0:{7 + 8 * 99_999 + 1}" in got[len(texts) - 2].spans or not got[len(texts) - 2].spans


def test_estimate_against_unweighted_rows():
    """EM over every single candidate gives what EM over counted patterns gives."""
    r = random.Random(4)
    rows = ["".join(r.choices("012", [1, 2, 4] if i % 3 else [4, 2, 1], k=4)) for i in range(900)]
    got = pii.estimate([(0, v + "213", n) for v, n in Counter(rows).items()], rounds=8)
    p = {v: 1 / (1 + math.exp(-sum(int(c) - 1 for c in v))) for v in rows}
    for _ in range(8):
        yes = sum(p[v] for v in rows)
        real, fake = [], []
        for j in range(4):
            real.append({c: (sum(p[v] for v in rows if v[j] == c) + s) / (yes + 3.5) for c, s in zip("012", (0.5, 1, 2), strict=True)})
            fake.append({c: (sum(1 - p[v] for v in rows if v[j] == c) + s) / (len(rows) - yes + 3.5) for c, s in zip("012", (2, 1, 0.5), strict=True)})
        prior = (yes + 1) / (len(rows) + 2)
        p = {v: (a := prior * math.prod(real[j][v[j]] for j in range(4))) / (a + (1 - prior) * math.prod(fake[j][v[j]] for j in range(4))) for v in p}
    assert all(abs(got[0, v] - q) < 1e-9 for v, q in p.items())


def test_classifier_uses_votes_and_traits():
    counts = [(4, "2222" + "313", 400), (4, "2212" + "313", 300), (4, "0101" + "001", 500), (4, "0011" + "001", 300), (4, "1111" + "313", 20), (4, "1111" + "001", 20)]
    w = pii.train(counts)
    score = lambda v: sum(a * b for a, b in zip(w, pii._features(4, v), strict=True))
    assert score("2222313") > 0 > score("0101001") and score("1111313") > score("1111001")
    assert pii.train([]) == [0.0] * pii.N_WEIGHTS


def plain_urls(urls, rules):
    """(rule, verdict) of each URL by counts of plain Python."""
    judged = {}
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match("[^/?#]*", rest)[0].lower(), re.match("[^/?#]*([^?#]*)", rest)[1]
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fit, key=lambda r: len(r[0] + r[1])) if fit else None
        judged[u] = (host + path, rule and rule[0] + rule[1], rule and rule[2])
    known = {u: (c, v) for u, (c, _, v) in judged.items() if u is not None}
    aside = {u for u in known if zlib.crc32(u.encode()) % 5 == 0}
    ngrams = lambda c: [p[max(0, i - k) : i + 1] for p in ["\2" * 4 + c + "\3"] for i in range(4, len(p)) for k in range(5)]
    seen = {v: Counter(g for u, (c, x) in known.items() if x == v and u not in aside for g in ngrams(c)) for v in ("allow", "block")}
    totals = {v: Counter() for v in seen}
    for v, counted in seen.items():
        for g, n in counted.items():
            totals[v][g[:-1]] += n
    chance = lambda v, g: math.log((seen[v][g] + 0.5 / 96) / (totals[v][g[:-1]] + 0.5))

    def score(c):
        p, gains = "\2" * 4 + c + "\3", []
        for i in range(4, len(p)):
            g = next((g for k in range(4, -1, -1) if (g := p[i - k : i + 1]) in seen["allow"] or g in seen["block"]), None)
            gains.append(chance("allow", g) - chance("block", g) if g else 0.0)
        return sum(gains) / len(gains)

    marks = {v: [score(known[u][0]) for u in aside if known[u][1] == v] for v in seen}
    (m1, v1), (m0, v0) = ((sum(x) / len(x), max(1e-6, sum(a * a for a in x) / len(x) - (sum(x) / len(x)) ** 2)) for x in (marks["allow"], marks["block"]))
    lo, hi = m0, m1
    for _ in range(60):
        mid = (lo + hi) / 2
        allow = -((mid - m1) ** 2) / (2 * v1) - math.log(v1) / 2 >= -((mid - m0) ** 2) / (2 * v0) - math.log(v0) / 2
        lo, hi = (lo, mid) if allow else (mid, hi)
    limit = (lo + hi) / 2
    return {u: (rule, v or ("allow" if (score(c) if u is not None else 0.0) >= limit else "block")) for u, (c, rule, v) in judged.items()}, m1 > m0


@pytest.mark.parametrize("share", [url_filter.HOT_SHARE, 30])
def test_url_model_against_plain_counts(spark, monkeypatch, share):
    monkeypatch.setattr(url_filter, "HOT_SHARE", share)
    r = random.Random(14)
    word = lambda parts: "".join(r.choice(parts) for _ in range(r.randint(2, 4)))
    good, bad = ["lib", "doc", "ref", "é"], ["win", "xx", "cash", "doc"]
    urls = [f"http://{word(bad)}.net/{word(bad)}" for _ in range(120)] + [f"http://{word(good)}.org/fr/{word(good)}?q=1" for _ in range(120)]
    urls += [f"http://{word(r.choice([good, bad]))}.io/{word(r.choice([good, bad]))}" for _ in range(150)] + ["http://same.io/a"] * 30 + [None, "", "x", "http://"]
    want, ordered = plain_urls(urls, url_filter.RULES)
    assert ordered and {v for _, v in want.values()} == {"allow", "block"}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.judge_urls(pages).collect()}
    assert got == {i: want[u] for i, u in enumerate(urls)}


def test_url_filter_without_examples(spark):
    pages = spark.createDataFrame([(1, "http://a.io/b", "x"), (2, None, "y"), (3, "http://q.net/", "z")], "page_id long, url string, verdict string")
    got = {x.page_id: x.verdict for x in url_filter.judge_urls(pages).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block"} and url_filter.judge_urls(pages.limit(0)).count() == 0
