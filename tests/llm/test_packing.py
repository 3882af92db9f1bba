import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hustings.llm import chunkmemo, common, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_chunks_encode_as_whole_texts(plain):
    r = random.Random(1)
    alphabet = list("ab'é \n.,1×_") + ["  ", "'s", "\t", "œ", "日", "<|endoftext|>"]
    texts = ["", "don't it's 'll", "a × b ÷ œuvre", "3rd 4.5", *["".join(r.choices(alphabet, k=r.randint(0, 14))) for _ in range(4000)]]
    got = packing.Encoder(PATH)(*common.text_buffers(pa.array(texts)))
    assert [x.tolist() for x in got] == [plain(t) for t in texts]


def test_chunks_under_one_hash_are_told_apart(plain, monkeypatch):
    """Whatever chunks share a hash, ids are those of the whole text."""
    texts = ["one two six", "ten one", "a longer word", "six ten two", "x" * 40 + " ten", "one", "two longer one"]
    monkeypatch.setattr(chunkmemo.shingles, "spans", lambda raw, start, end: ((end - start) % 3).astype(np.uint64))
    memo = packing.Encoder(PATH)
    for _ in range(2):
        assert [x.tolist() for x in memo(*common.text_buffers(pa.array(texts)))] == [plain(t) for t in texts]


@pytest.mark.parametrize("bits", [11, 12])
def test_words_that_polynomials_modulo_a_power_of_two_confuse(plain, thue_morse, bits):
    words = thue_morse(bits)
    memo = packing.Encoder(PATH)
    assert [memo(*common.text_buffers(pa.array([w])))[0].tolist() for w in words] == [plain(w) for w in words]


def check(rows, texts, plain, size):
    """Every id in one piece, pieces gapless in their sequences, nothing padded but to a power of two or the size."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id, x.doc_tokens].append(x)
        by_seq[x.sequence_id].append(x)
    for seq in by_seq.values():
        seq.sort(key=lambda x: x.offset)
        at = 0
        for x in seq:
            assert x.offset == at and x.length > 0
            at += x.length
        assert at <= size and (at == size or at & (at - 1) == 0)
    for doc_id, text in texts:
        ids = np.array([*plain(text or ""), 1], "<u4")
        own = by_doc[doc_id, len(ids)]
        assert sum(x.length for x in own) == len(ids) * texts.count((doc_id, text))
        for x in own:
            assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())


def test_pack_edges(edge_docs, plain):
    rows = packing.pack(edge_docs, PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in edge_docs.collect()], plain, 2048)
    whole = sum(len(plain(r.text or "")) + 1 for r in edge_docs.collect())
    assert sum(x.length for x in rows) == whole


def test_pack_empty(no_docs):
    assert packing.pack(no_docs, PATH).collect() == []


def test_sum_of_squares_takes_the_best_level():
    r = random.Random(3)
    size = 16
    p, levels, fill = packing.SumOfSquares(size, 10_000), [0] * (size + 1), {}
    for _ in range(400):
        n = r.randint(1, size)
        options = {}
        for h in range(0, size - n + 1):
            if h and not levels[h]:
                continue
            after = levels[:]
            if h:
                after[h] -= 1
            if h + n < size:
                after[h + n] += 1
            options[h] = sum(c * c for c in after)
        window, offset, taken = p.place(n)
        assert taken == n and options[offset] == min(options.values())
        assert fill.get(window, 0) == offset
        fill[window] = offset + n
        if offset:
            levels[offset] -= 1
        if offset + n < size:
            levels[offset + n] += 1


def placed(packer, lengths):
    """Windows' fills after documents of some lengths, each id placed once."""
    fill = {}
    for n in lengths:
        while n:
            window, offset, taken = packer.place(min(packer.size, n))
            assert 0 < taken <= n and fill.get(window, 0) == offset and offset + taken <= packer.size
            fill[window] = offset + taken
            n -= taken
            assert packer.now_open == sum(0 < f < packer.size for f in fill.values()) <= packer.most
    return fill


@pytest.mark.parametrize("lengths", [[1100] * 3000, [random.Random(5).randint(1, 5000) for _ in range(2000)], [1] * 100, [2047, 2] * 50])
def test_open_windows_are_bounded(lengths):
    fill = placed(packing.SumOfSquares(2048, 16), lengths)
    assert sum(fill.values()) == sum(lengths) and sum(f < 2048 for f in fill.values()) <= 16


@given(st.integers(2, 40), st.integers(1, 5), st.lists(st.integers(1, 90), max_size=60))
def test_any_lengths_are_placed(size, most, lengths):
    placed(packing.SumOfSquares(size, most), lengths)


def test_almost_all_pieces_stay_where_the_rule_puts_them(spark, docs, plain, monkeypatch):
    """The pieces of at most most_open windows are laid anew at the end of a task."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randint(0, 999)}" for _ in range(r.randint(1, 600))) for _ in range(400)]
    rows = packing.pack(docs(texts).coalesce(1), PATH).collect()
    packer, fill, own = packing.SumOfSquares(2048, 16), {}, set()
    for doc_id, text in enumerate(texts, 1):
        total, start = len(plain(text)) + 1, 0
        while start < total:
            window, offset, taken = packer.place(min(2048, total - start))
            own.add((doc_id, start, taken, window, offset))
            fill[window] = offset + taken
            start += taken
    stays = {p for p in own if fill[p[3]] == 2048}
    assert stays <= {(x.doc_id, x.start, x.length, x.sequence_id, x.offset) for x in rows}
    ids = lambda ps: sum(p[2] for p in ps)
    assert ids(stays) >= ids(own) - 16 * 2048
