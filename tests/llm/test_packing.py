import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from usageloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_tokenizer(odd_texts):
    whole = Tokenizer.from_file(PATH)
    texts = [t or "" for _, t in odd_texts] + ["it's 'tis <|endoftext|>x É ÀÉ a\x1fb \x85c\xa0d ª½", "Σας İ ﬁ 3.5% don't've"]
    for text, got in zip(texts, packing.token_bytes(PATH, texts)):
        assert got == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_of_all_latin_pairs_and_of_cut_columns_equal_the_tokenizer():
    whole = Tokenizer.from_file(PATH)
    texts = [f"x{chr(a)}{chr(b)}'S{chr(b)} 1" for a in range(257) for b in range(257)]
    texts += ["<|ENDOFTEXT|>", "x<|startoftext|>'ll", "", " \t"]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert packing.token_bytes(PATH, texts) == want
    for first, rows in ((5, 1000), (len(texts) - 2, 2), (3, 0)):
        for kind in (pa.string(), pa.large_string()):
            cut = pa.array(texts, kind).slice(first, rows)
            assert packing.token_bytes(PATH, cut) == want[first : first + rows]


def test_new_words_of_known_parts_take_no_python_calls():
    parts = [f"{a}{b}" for a in "bdgklmnprt" for b in ("a", "e", "ou", "I")]
    words = [f"{a}{mark}{b}" for a in parts for b in parts for mark in ".,;:-!?/()"]
    packing.token_bytes(PATH, [" ".join(parts), " ".join(words[:10])])
    calls = []
    sys.setprofile(lambda frame, event, _: calls.append(event))
    try:
        (got,) = packing.token_bytes(PATH, [" ".join(words)])
    finally:
        sys.setprofile(None)
    assert len(calls) < len(words) / 10
    whole = Tokenizer.from_file(PATH)
    assert got == np.array(whole.encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_fill_sequences_without_gaps(make_docs, odd_texts):
    docs = make_docs(odd_texts, clash=True)
    rows = packing.pack_documents(docs, PATH).collect()
    whole = Tokenizer.from_file(PATH)
    want = sorted(
        (str(d), at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()))
        for d, t in odd_texts
        for ids in [whole.encode(t or "", add_special_tokens=False).ids + [1]]
        for at in range(0, len(ids), 4096)
    )
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r.length for r in rows) // 4096)
    assert len(sequences) <= least + 1
    assert packing.pack_documents(make_docs([]), PATH).count() == 0


def test_sum_of_squares_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 4097, 800), rng.integers(1, 300, 2000), np.full(50, 4096), np.array([2048] * 9)):
        bins = packing.sum_of_squares(lengths)
        assert sorted(i for own in bins for i in own) == list(range(len(lengths)))
        assert max(lengths[own].sum() for own in bins) <= 4096
        big = (lengths > 2048).sum()
        assert len(bins) <= max(-(-lengths.sum() // 4096) * 1.02 + 1, big + 1)
