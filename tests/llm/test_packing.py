import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tests.llm.helpers import documents
from tokenizers import Tokenizer

from sessionloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_every_id_lies_in_one_piece_and_sequences_are_gapless(spark):
    docs = documents(spark)
    rows = packing.pack_documents(docs, PATH, window=64, keep_ids=True).collect()
    real = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append([*real.encode(r.text or "", add_special_tokens=False).ids, 0])
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, pieces in got.items():
        total = len(want[doc][0])
        assert all(p.doc_tokens == total for p in pieces)
        by_start = sorted(pieces, key=lambda p: p.start)
        copies = len(want[doc])
        joined = [i for p in by_start[::copies] for i in p.ids]
        assert joined == want[doc][0] and len(by_start) % copies == 0
    assert set(got) == set(want)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64 and all(p.sequence_tokens == at for p in pieces)
        assert pieces[0].padded_length == (at if at & (at - 1) == 0 else 64)


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for _ in range(200):
        window = rng.choice([10, 16, 100])
        lengths = np.array([rng.randint(1, window) for _ in range(rng.randint(0, 60))], np.int64)
        bins, offsets, filled = packing.best_fit_decreasing(lengths, window)
        left, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [c for c in left if c >= lengths[i]]
            if fits:
                left.remove(min(fits))
                want[i] = min(fits) - lengths[i]
            else:
                want[i] = window - lengths[i]
            if want[i]:
                left.append(want[i])
        assert sorted(window - f for f in filled) == sorted([*left, *[0] * (len(filled) - len(left))])
        assert all(window - offsets[i] - lengths[i] == want[i] for i in want)


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0


def test_encoder_agrees_with_the_library_on_odd_texts():
    fast, real = packing.ByteBpe(PATH), Tokenizer.from_file(PATH)
    for text in ["", " ", "  a  b ", "don't STOP\n\n\tnow", "<|endoftext|>x<|endoftext|>", "ab" * 3000, "日本語😀é", "1234 5678", "x" * 1999 + " y"]:
        assert fast.encode(text).tolist() == real.encode(text, add_special_tokens=False).ids
