import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import bpe, storage, token_records
from panelwright.llm.pieces import cut

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.vocabulary_path()


def texts():
    r = random.Random(1)
    letters = list(" \n\t ab1é'.,- \x1c\x85日<|#$")
    fixed = ["", " ", "  a", "a  b", "a \n b", "\n\n x \n \n y", "a\n\n\nb c\nd", "<|endoftext|>", "a <|endoftext|> b", "don't I'll 'S", "é" * 900 + " " + "ab" * 600, "日本語 テキスト 123 ４５", "\t\tx\r\n y", "🎉 🎊‍ x", "x　 y", "word, word. word### word's"]
    return fixed + ["".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(1500)]


def test_rank_array_equals_the_library():
    t, own = tokenizers.Tokenizer.from_file(PATH), bpe.load(PATH)
    for text, e in zip(texts(), t.encode_batch(texts(), add_special_tokens=False), strict=True):
        assert own.encode(text) == e.ids, text
        assert own.decode(e.ids) == t.decode(e.ids, skip_special_tokens=False)
    each, index, first = own.encode_many(pa.array(texts()))
    for i, e in enumerate(t.encode_batch(texts(), add_special_tokens=False)):
        assert [x for k in index[first[i] : first[i + 1]] for x in each[k]] == e.ids


def test_texts_with_unusual_white_space_are_not_cut():
    for c in filter(str.isspace, map(chr, range(0x11000))):
        entries, n_parts, _, _ = cut(pa.array([f"a{c}b", "a b"]))
        assert len(entries) - n_parts == (c not in " \n"), hex(ord(c))


def test_piece_encoder_equals_the_library():
    t, own = tokenizers.Tokenizer.from_file(PATH), token_records.PieceEncoder(PATH)
    for _ in range(2):
        ids, first = own.encode(pa.array([*texts(), None]))
        assert [list(ids[a:b]) for a, b in zip(first, first[1:], strict=False)] == [*(e.ids for e in t.encode_batch(texts(), add_special_tokens=False)), []]


def docs(spark):
    rows = [(i * 7 % 101, x) for i, x in enumerate(texts()[:101])] + [(None, "no id"), (500, None)]
    return spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, start int, ids int")


def test_round_trip(spark):
    import hashlib

    got = {r.doc_id: r for r in bpe.round_trip(docs(spark), PATH).collect()}
    assert got[500].n_tokens == 0 and got[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode_column(bpe.encode_column(docs(spark), PATH), PATH).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs(spark).collect()}


def test_records_and_shuffled_reads(spark):
    folder = storage.scratch(spark, "records")
    index = token_records.write_records(docs(spark), folder, PATH, 2, shards=3)
    t, start = tokenizers.Tokenizer.from_file(PATH), 0
    want, ids_of = [], {}
    for r in sorted(docs(spark).collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        ids_of[r.doc_id] = ids
        start += len(ids)
    got = [tuple(r) for r in token_records.read_records(spark, index).collect()]
    assert sorted(got, key=lambda x: x[1]) == want
    assert {r.doc_id: r.ids for r in token_records.read_shuffled(index, 3, 2).collect()} == ids_of
    empty = token_records.write_records(docs(spark).limit(0), storage.scratch(spark, "records"), PATH, 2)
    assert token_records.read_records(spark, empty).count() == 0


def test_damage_is_found():
    import io

    good = token_records.frame(b"payload")
    assert list(token_records.frames(io.BytesIO(good * 2), "x")) == [b"payload"] * 2
    for at in (0, 9, 14, len(good) - 1):
        with pytest.raises(ValueError):
            list(token_records.frames(io.BytesIO(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]), "x"))
