import hashlib
import random
import re

import pytest
import xxhash

import corpus_pipeline
from panelwright.llm import components, decontaminate, exact_dedup, rows, simhash
from panelwright.llm.exact_dedup import CuckooIndex

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, key int, group_size long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "d", 1, 2) for i, t in rows], DOCS)


def test_cuckoo_index_inserts_deletes_and_grows():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    index = CuckooIndex(4)
    assert all(index.add(k, b"x") for k in keys) and not any(index.add(k, b"x") for k in keys)
    assert index.filter.mask > 512 and all(index.find(k, b"x") for k in keys) and not index.find(keys[0], b"y")
    for k in keys[::2]:
        assert index.remove(k, b"x") and index.find(k, b"x") and index.remove(k, b"x")
    assert not any(index.find(k, b"x") for k in keys[::2]) and all(index.find(k, b"x") for k in keys[1::2])
    assert not index.remove(keys[0], b"x") and index.add(keys[1], b"other") and index.live[keys[1]] == [[b"x", 2, None], [b"other", 1, None]]


def indexed(rows, **changed):
    """What the index of one bucket makes of rows (key, content), with parts of it put out of order."""
    class Filter(exact_dedup.CuckooFilter):
        may_hold = changed.get("may_hold", exact_dedup.CuckooFilter.may_hold)

    class Index(CuckooIndex):
        find = changed.get("find", CuckooIndex.find)

    index = Index()
    index.filter = Filter(64)
    for i, (key, content) in enumerate(rows):
        index.add(key, content, 1, i)
    return sorted((c, n, i) for entries in index.live.values() for c, n, i in entries)


def test_the_filter_and_its_verification_decide():
    key = hashlib.sha256(b"k").digest()
    rows = [(key, b"a"), (key, b"b"), (key, b"a"), (key[:10] + bytes(22), b"c")]
    want = [(b"a", 2, 2), (b"b", 1, 1), (b"c", 1, 3)]
    assert indexed(rows) == want
    assert indexed(rows, may_hold=lambda self, key: False) == [(b"a", 1, 0), (b"a", 1, 2), (b"b", 1, 1), (b"c", 1, 3)]
    trusting = lambda self, key, content: next(iter(self.live.values()))[0] if self.filter.may_hold(key) else None
    assert indexed(rows, find=trusting) == [(b"a", 4, 3)]


@pytest.mark.parametrize("size", [20, 1 << 20])
def test_exact_dedup_in_many_buckets(spark, monkeypatch, size):
    r = random.Random(8)
    monkeypatch.setattr(exact_dedup, "BUCKET_BYTES", size)
    monkeypatch.setattr(exact_dedup, "HELD_BYTES", 300)
    rows = [(r.choice([None, *range(900)]), r.choice([None, "", "A", "a", "É", *(r.choice("xX") * n for n in range(40))])) for _ in range(600)]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    members = {}
    for i, t in rows:
        members.setdefault(low(t), []).append(i)
    most = {t: max((i for i in ids if i is not None), default=None) for t, ids in members.items()}
    want = [(i, most[low(t)], len(members[low(t)]), i == most[low(t)], hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows]
    assert sorted(map(str, map(tuple, exact_dedup.exact_dedup(docs(spark, rows).repartition(3)).collect()))) == sorted(map(str, want))


def test_exact_dedup(spark):
    rows = [(1, "Ab"), (5, "aB"), (3, "É"), (4, "é"), (7, None), (8, ""), (5, "aB"), (9, "x" * 100_000), (10, "X" * 100_000)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    assert (got[1].keep_id, got[1].group_size, got[1].kept) == (5, 3, False)
    assert got[3].kept and got[4].kept and got[7].keep_id == 8 and got[9].keep_id == 10
    assert got[1].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    kept = exact_dedup.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8, 10]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_keep_one_with_null_and_reused_ids(spark):
    rows = [(5, "A"), (5, "B"), (9, "a"), (7, "C"), (7, "D"), (7, "c"), (None, "D"), (None, "É"), (None, "É"), (None, "é"), (None, None), (3, "")]
    table = docs(spark, rows)
    got = exact_dedup.keep_one(table)
    assert got.schema == table.schema
    kept = [(r.doc_id, (r.text or "").replace("C", "c")) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(5, "B"), (9, "a"), (7, "c"), (7, "D"), (None, "É"), (None, "é"), (3, "")], key=str)


def test_index_over_batches(spark):
    first = exact_dedup.update_index(None, docs(spark, [(1, "a"), (2, "b"), (3, "A")]))
    second = exact_dedup.update_index(first, docs(spark, [(4, "c"), (9, None)]), docs(spark, [(2, "b"), (1, "a"), (7, "never")]))
    assert sorted((r.content, r.n, r.keep_id) for r in second.collect()) == [(b"", 1, 9), (b"a", 1, 3), (b"c", 1, 4)]
    seen = {r.doc_id: r.seen for r in exact_dedup.seen_before(second, docs(spark, [(1, "a"), (2, "B"), (3, "c"), (4, "z"), (5, "")])).collect()}
    assert seen == {1: True, 2: False, 3: True, 4: False, 5: True}
    assert exact_dedup.update_index(None, docs(spark, [])).count() == 0


def plain_fp(text, size=3):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    g = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("large", [simhash.LARGE, 3])
def test_simhash_against_brute_force(spark, large, monkeypatch):
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 60))) for _ in range(25)]
    texts = [b for t in base for b in [t, t.upper(), t + " z", " ".join(t.split()[:-1])]] + [None, "", "one", "one two"]
    monkeypatch.setattr(simhash.near_links, "__defaults__", (2, large))
    got = {x.doc_id: x for x in simhash.near_groups(docs(spark, list(enumerate(texts)))).collect()}
    fps = [plain_fp(t) for t in texts]
    want = groups(range(len(texts)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert {i: (x.fingerprint, x.component_id) for i, x in got.items()} == {i: (f"{fps[i]:016x}", want[i]) for i in want}


def test_bit_slices_against_popcount():
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(40)]
    fps += [f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for f in fps[:20]]
    block = simhash.BitSlices([f.to_bytes(8, "little") for f in fps])
    for radius in (0, 1, 2, 3, 7, 20, 33):
        for i, f in enumerate(fps):
            want = sum(1 << j for j, g in enumerate(fps) if (f ^ g).bit_count() <= radius)
            assert block.within(i, radius, (1 << len(fps)) - 1) == want


@pytest.mark.parametrize(("large", "drawn"), [(simhash.LARGE, 64), (5, 64), (5, 2)])
def test_similar_groups_find_near_copies(spark, monkeypatch, large, drawn):
    monkeypatch.setattr(simhash, "REPRESENTATIVES", drawn)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    originals = [[word() for _ in range(250)] for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    for i, w in enumerate(originals):
        for k in range(8 if i == 0 else 1):
            c = list(w)
            c[20 * k + 7] = word()
            rows.append((100 * (k + 1) + i, " ".join(c)))
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(docs(spark, rows), large=large).collect()}
    assert got == {i: i % 100 for i, _ in rows}


def plain_similar(rows, similarity=0.8):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    alike = lambda a, b: len(a & b) / len(a | b) >= similarity
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    roots = groups(range(len(rows)), linked)
    return {rows[i][0]: rows[roots[i]][0] for i in {i for pair in linked for i in pair}}


def test_similar_groups_against_brute_force(spark):
    r = random.Random(21)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    texts = []
    for changes in range(12, 42):  # one copy each, at a similarity of 0.9 down to 0.7
        w = words(1200)
        c = list(w)
        for k in range(changes):
            c[29 * k + 3] = "new" + str(k)
        texts += [w, c]
    for n in range(1, 12):
        w = words(n)
        texts += [w, w + words(1), words(1) + w]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(docs(spark, rows)).collect()}
    assert got == plain_similar(rows) and 20 < len(got) < len(rows) - 20


def test_similar_groups_count_a_repeated_shingle_once(spark):
    r = random.Random(22)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    line, texts = words(40), []
    for _ in range(20):
        texts += [line * 100 + words(300), words(300)]
        texts.append(texts[-1] + texts[-1][:20] * 50)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = plain_similar(rows)
    assert len(want) == 40 and {x.doc_id: x.component_id for x in simhash.similar_groups(docs(spark, rows)).collect()} == want


def test_similar_groups_in_large_blocks_with_one_equal_minimum(spark, monkeypatch):
    r = random.Random(23)
    ids = list(range(60))
    prints = {i: r.getrandbits(512) for i in ids[::2]}
    prints |= {i + 1: f ^ (1 << r.randrange(512)) for i, f in prints.items()}
    key = lambda i: hashlib.sha256(f"the words of pair {i // 2} are these".encode()).hexdigest()
    marked = [(i, key(i), prints[i].to_bytes(64, "little"), [7, *(100 * i + k for k in range(5))], b"%d" % i) for i in ids]
    sketch = spark.createDataFrame(marked, "doc_id long, row_key string, fp binary, minima array<long>, same binary")
    monkeypatch.setattr(simhash, "sketches", lambda docs, shingle: sketch)
    rows = [(i, f"the words of pair {i // 2} are these") for i in ids]
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(docs(spark, rows), large=8).collect()}
    assert got == {i: i - i % 2 for i in ids}


@pytest.mark.parametrize("shape", ["shuffled", "star", "scattered"])
def test_components_in_few_rounds(spark, monkeypatch, shape):
    r, n, written = random.Random(6), 10_000, []
    nodes = r.sample(range(n), n)
    pairs = {"star": [(nodes[0], x) for x in nodes[1:]], "scattered": [(r.randrange(n), r.randrange(n)) for _ in range(n // 2)]}.get(shape, list(zip(nodes, nodes[1:], strict=False)))
    links = spark.createDataFrame(pairs + [(20_001, 20_000), (20_001, 20_002), (20_001, 20_000), (30_000, 30_000), (None, 1)], "a long, b long")
    keep = components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: written.append(name) or keep(df, name))
    got = {x.node: x.root for x in components.components(links).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    want = groups(range(n), pairs)
    assert got == {i: want[i] for i in linked} | dict.fromkeys((20_000, 20_001, 20_002), 20_000)
    assert len(written) <= 17
    assert components.components(links.limit(0)).count() == 0


def test_recall_of_planted_near_copies(spark):
    """Pairs at a similarity of 0.80 to 0.85, in blocks of any size and cut into chunks."""
    r = random.Random(31)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows = []
    for i in range(100):
        w = words(400)
        c = list(w)
        for k in range(6 + i % 3):
            c[40 * k + 5] = "new" + str(k)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(c))]
    want = plain_similar(rows)
    assert len(want) == 200
    for large in (simhash.LARGE, 4):
        got = {x.doc_id: x.component_id for x in simhash.similar_groups(docs(spark, rows), large=large).collect()}
        assert sum(got.get(i) == c for i, c in want.items()) >= 0.9 * len(want) and set(got) <= set(want)


@pytest.mark.parametrize("ids", [rows.BROADCAST_IDS, 0])
@pytest.mark.parametrize("stage", ["exact", "near", "benchmark"])
def test_stages_judge_rows(spark, monkeypatch, stage, ids):
    """Null and repeated doc_ids, repeated rows, columns named like helpers, and empty tables."""
    monkeypatch.setattr(rows, "BROADCAST_IDS", ids)
    one, two, bad = "The quick brown fox jumps over the lazy dog", "A wholly different text of some words", "leak leak of the secret test items"
    table_rows = [(1, one), (1, two), (1, two), (9, two + "s"), (None, one), (None, bad), (5, bad), (5, None), (None, ""), (9, one)]
    table = spark.createDataFrame([(i, t, 1, 2, 3, 4, "x") for i, t in table_rows], "doc_id long, text string, gone int, twice int, hit_doc int, count int, row_key string")
    bench = spark.createDataFrame([(1, bad)], "item_id long, text string")
    run = {"exact": exact_dedup.keep_one, "near": simhash.drop_similar, "benchmark": lambda t: decontaminate.remove_contaminated(t, bench)}[stage]
    kept = {
        "exact": [(1, two), (9, two + "s"), (5, bad), (5, None), (9, one)],
        "near": [(1, one), (1, two), (9, two + "s"), (5, bad), (5, None)],
        "benchmark": [r for r in table_rows if r[1] != bad],
    }[stage]
    got = run(table)
    assert got.schema == table.schema and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(kept, key=str)
    assert run(table.limit(0)).count() == 0


def test_pipeline_stages_on_small_documents(spark, tmp_path):
    r = random.Random(2)
    word = lambda: "".join(r.choice(["the", "tion", "ing", "er", "an", "on"]) for _ in range(2))
    text = [" ".join(word() + str(i) * 0 for _ in range(120)) for i in range(8)]
    leak = " ".join(f"bench{chr(97 + i)}" for i in range(12))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(text)] + [(20, text[0].upper(), "en", "s", 1), (21, text[1] + " end", "en", "s", 1), (22, f"{text[2][:200]} {leak} tail", "en", "s", 1), (23, "12 34", "en", "s", 1), (24, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in out) == [1, 2, 3, 4, 5, 6, 7, 20] and all(x.n_tokens > 0 for x in out)


def test_stages_of_empty_tables_and_odd_ids(spark, tmp_path):
    """No stage fails on an empty table; null and repeated doc_ids lose no other row in the first and the last stage."""
    from panelwright.llm import bpe, language

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], schema)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert bpe.round_trip(none, bpe.vocabulary_path()).count() == 0 and simhash.near_groups(none).count() == 0
    text = {"en": "the cat and the dog went to the old house by the river", "de": "der Hund und die Katze gingen zu dem alten Haus am Fluss"}
    rows = [(i, t + f" {i}", k, None, None) for i in range(12) for k, t in text.items()] + [(None, text["en"], None, "s", 1), (None, "12 ;", "en", None, None), (3, text["de"], None, None, 2), (3, text["de"], None, None, 2), (None, None, None, None, None)]
    table = spark.createDataFrame([(*r, 7, True) for r in rows], schema + ", score int, held_out boolean")
    kept = language.keep_identified(table, language.fit(language.learned_rows(table.drop("held_out"))))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(r[0]), r[1]) for r in rows if r[1] and r[1] != "12 ;") and kept.columns == table.columns
    tokens = bpe.round_trip(table, bpe.vocabulary_path()).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in tokens) == sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
