import re
import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lureframe.llm import mixing as M
from lureframe.llm import packing as P


def water(sizes, weights, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, active, out = share * sum(sizes.values()), set(names), {}
    while active:
        total = sum(w[s] for s in active)
        over = [s for s in active if left * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in active}
        for s in over:
            out[s] = most * sizes[s]
            active.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def test_mix_reaches_targets(docs):
    rows = [(i, "w " * (i % 37), "big" if i % 3 else f"s{i % 7}" if i % 5 else None) for i in range(900)]
    got = M.mix(docs(rows), range_rows=50).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = water(sizes, (3, 1, 2))
    assert len(got) == 900 and all(r["size"] == r["doc_id"] % 37 for r in got)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) < 1.001 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, M.mix(docs(rows).repartition(7), range_rows=50).collect()), key=str)


def test_mix_of_odd_rows(docs, odd, none):
    got = M.mix(odd).collect()
    assert len(got) == 9 and sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), abs=1)
    out = M.mixed_documents(odd)
    assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} <= {4, 5, 6, 7, None}
    assert [r["taken"] for r in M.mix(docs([(1, None), (2, " ")])).collect()] == [0, 0]
    assert M.mix(none).count() == 0 and M.mixed_documents(none).count() == 0


def test_words_are_counted_as_the_contract_says(docs):
    text = "a b \x1cc\x85 \t\n\v\f\rd  é\x00"
    assert M.mix(docs([(1, text)])).first()["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_every_length_is_placed_once(histogram):
    made = P.shortest_pack_first(histogram, 64)
    placed = {}
    for packs, lengths in made:
        assert sum(lengths) <= 64
        for length in lengths:
            placed[length] = placed.get(length, 0) + packs
    assert placed == histogram


@cache
def whole_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture
def tokenizer():
    return whole_tokenizer()


SPACES = ["", " ", "a  b", "a   b", " a", "a ", "a \n b", "a\n \nb", "a\n b  \n\n c ", "  ", "\ta \t b", "é  ü  x", "it's  I'll 12 3,4", "a  b   c", "x" * 3000]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.sampled_from(SPACES), st.text(alphabet=" \n\tab'1é.,  ", max_size=40)))
def test_ids_equal_the_tokenizers_library(text):
    whole = whole_tokenizer()
    assert np.frombuffer(P.token_bytes(text, P.Encoded(P.VOCABULARY)), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def packed_is_sound(rows, texts, tokenizer, width):
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        ends = [0, *[o + n for o, n in s]]
        assert [o for o, _ in s] == ends[:-1] and ends[-1] <= width
    assert sorted(sequences) == list(range(len(sequences)))
    return by_doc, ids


def test_pack(docs, tokenizer):
    texts = ["word " * n for n in (0, 1, 3, 10, 300, 2047, 2048, 5000, 7, 7, 7)]
    rows = P.pack(docs(list(enumerate(texts)))).collect()
    by_doc, ids = packed_is_sound(rows, texts, tokenizer, 2048)
    for i, want in enumerate(ids):
        for r in by_doc[i]:
            assert zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want)


def test_pack_odd_rows(odd, none, tokenizer):
    rows = P.pack(odd).collect()
    packed_is_sound(rows, [r["text"] for r in odd.collect()], tokenizer, 2048)
    assert P.pack(none).count() == 0


def test_a_hot_length_is_ranked_in_parts(docs, tokenizer):
    rows = P.pack(docs([(i, "same text") for i in range(500)]), rank_rows=20).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 500
    packed_is_sound(rows, ["same text"] * 500, tokenizer, 2048)
