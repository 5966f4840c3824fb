import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import tokens
from quernstone.llm.codepoints import block_of, blocks, scan, word_slices

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def mine(texts, limit=3_000_000):
    out = []
    for _, _, block in blocks(pa.array(texts, pa.string()), limit):
        ids, ends, _ = tokens.encode_block(block, tokens.VOCABULARY)
        out += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    return out


CASES = [
    "", None, " ", "\n\n", "it's don't we'll they've 'tis x''s ''re 's's 'sabc", " 's  's\n's\t 'll", "a\n\n b\n", "  a   b  ", " x   y", "<|endoftext|> hi", "'", "a'", "'r", "'re", "é'd 12's 'D", "日本語 ½ Ⅷ 😀😀 e\u0301\u200b",
    "x" * 3000, "ab" * 3000, "\u3000\u2003x \x1c\x85", "'" * 500, "1" * 400, "'ve" * 50,
]


def test_ids_are_the_librarys(library):
    expected = [e.ids for e in library.encode_batch([c or "" for c in CASES], add_special_tokens=False)]
    assert mine(CASES) == expected
    assert mine(CASES, limit=1) == expected  # a text a block


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("astrevld'' \n\t0é-日"), max_size=30), min_size=1, max_size=4))
def test_ids_of_any_text(library, texts):
    assert mine(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_round_trip(text):
    assert tokens.decode(mine([text])[0]) == text


def test_long_and_short_merging_agree():
    m = tokens.merger(tokens.VOCABULARY)
    for piece in (b"abcabcabd", b"zzzzzzzz", "überstraße".encode(), b" the", b"qxqxqxqxqxqxqxqx"):
        assert m.merge_many([piece], 32) == [m.merge_long(piece)]


def test_encode_keeps_every_row(spark, library):
    rows = [(1, "Hello world", "x", 5), (2, None, "x", 6), (3, "", "x", 7), (1, "Hello world", "x", 5), (None, " é!", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, k int")
    got = tokens.encode(df, offsets=True).collect()
    assert [(r.doc_id, r.ids) for r in got] == [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert got[0].offsets == [0, 5] and got[4].offsets[0] == 0 and got[1].offsets == []
    assert tokens.encode(df.limit(0)).collect() == []


def test_scan_equals_stepping():
    r = np.random.default_rng(1)
    to = r.integers(0, 4, (3, 4)).astype(np.uint8)
    to[2] = 1  # a symbol that resets
    symbols = r.choice(3, 500, p=[0.3, 0.3, 0.4])
    state, steps = 0, []
    for s in symbols:
        state = to[s, state]
        steps.append(state)
    assert scan(symbols, to).tolist() == steps


def test_words():
    starts, coded = word_slices(block_of(pa.array(["Ab-1é x", "", "x"])))
    assert coded.to_pylist() == ["Ab", "1é", "x", "x"] and starts.tolist() == [0, 3, 6, 7]
