import random
from hashlib import sha256

import numpy as np
import pyarrow as pa

from sessionloom.llm import bwtmerge
from tests.llm.helpers import AWKWARD, documents


def plain(rows):
    """Spans and kept bytes by a table of all strings of 50 bytes."""
    first = {}
    last = lambda i: bwtmerge.LAST if i is None else i
    texts = [(last(i), (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for s in range(len(t) - 49):
            x = t[s : s + 50]
            first[x] = min(i, first.get(x, i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            b = gone.find(0, a)
            at = len(t) if b < 0 else b
            spans.append((a, at))
        out.append((None if i == bwtmerge.LAST else i, len(t), tuple(spans), bytes(x for x, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def got(df, **options):
    return sorted(((r.doc_id, r.n_bytes, tuple((x.start, x.end) for x in r.spans), bytes(r.kept)) for r in bwtmerge.remove_repeats(df, **options).collect()), key=str)


def prose(r, n):
    return " ".join(r.choice(["alpha", "βeta", "gamma", "delta", "ε", "zeta", "eta\n", "theta"]) + str(r.randrange(6)) for _ in range(n))


def mixed(r, n):
    shared = [prose(r, r.randint(4, 40)) for _ in range(5)] + ["=" * 80, "ab" * 60]
    rows = []
    for i in range(n):
        rows.append((r.choice([i, i, r.randrange(n)]), "".join(r.choice([prose(r, r.randint(1, 15)), r.choice(shared), r.choice(shared)[r.randint(0, 9) :]]) for _ in range(r.randint(1, 5)))))
    return rows + [(3, rows[5][1]), (n + 1, rows[0][1]), (n + 2, rows[0][1]), (None, rows[1][1]), (None, rows[1][1])]


def test_removed_passages_match_a_table_of_all_strings(spark):
    rows = mixed(random.Random(1), 70)
    assert got(documents(spark, rows), block=2000) == plain(rows)


def test_anchors_of_many_documents_are_split(spark):
    rows = mixed(random.Random(2), 40)
    assert got(documents(spark, rows), block=1500, hot=4) == plain(rows)


def test_split_anchors_lie_in_many_buckets(monkeypatch):
    """all strings of a split anchor came to one task, which sorted their suffixes at once."""
    r = random.Random(6)
    line = "a line that is in each of the documents, in other words around it; "
    texts = [(prose(r, 9) + line + prose(r, 9)).encode() for _ in range(30)]
    left = pa.table({"id": pa.array(range(30), pa.int64()), "data": pa.array(texts, pa.binary()), "block": pa.array([0] * 30, pa.int64())})
    asked = bwtmerge._ask(4)(left)
    flags = pa.array([b"\2" * (len(x) // 2) for x in asked["n"].to_pylist()], pa.binary())
    pieces = bwtmerge._pieces(4, 64)(left, pa.table({"part": asked["part"], "flags": flags}))
    size = [len(bwtmerge._unpack(x, *bwtmerge.ASKED)[0]) for x in pieces["asked"].to_pylist()]
    assert len(size) == 64 and max(size) < 0.05 * sum(size) and pieces["bucket"].to_pylist() == list(range(64))
    monkeypatch.setattr(bwtmerge, "least_ids", None)
    told = [bwtmerge._repeats(pieces.slice(i, 1))["told"].to_pylist() for i in range(64)]
    assert any(told)


def test_long_texts_come_in_parts(spark, monkeypatch):
    rows = mixed(random.Random(3), 20)
    texts = [t.encode() for _, t in rows]
    whole = bwtmerge.anchors(texts)
    monkeypatch.setattr(bwtmerge, "BUFFER", 90)
    parts = bwtmerge.anchors(texts)
    at = lambda x: {(int(i), int(s) + k, int(v)) for v, i, s, n in zip(*x) for k in range(int(n))}
    assert at(whole) == at(parts) and len(at(whole)) == sum(max(0, len(t) - 49) for t in texts)


def test_merged_transforms_give_the_least_id_of_each_string(monkeypatch):
    monkeypatch.setattr(bwtmerge, "SHARD", 500)
    r = random.Random(4)
    short = lambda n, k: bytes(r.choice(b"abcdefgh"[:k]) for _ in range(n))
    for _ in range(40):
        pool = [short(r.randint(50, 120), 3) for _ in range(6)]
        pieces = [b"".join(r.choice([r.choice(pool)[r.randint(0, 30) :], short(r.randint(1, 40), 2), b"ab" * r.randint(1, 60)]) for _ in range(4)) for _ in range(r.randint(1, 40))]
        pieces = [p for p in pieces if len(p) >= 50]
        ids = np.asarray([r.randint(0, 20) for _ in pieces])
        want = {}
        for p, i in zip(pieces, ids.tolist()):
            for s in range(len(p) - 49):
                want[p[s : s + 50]] = min(i, want.get(p[s : s + 50], 99))
        assert not pieces or bwtmerge.least_ids(pieces, ids).tolist() == [want[p[s : s + 50]] for p in pieces for s in range(len(p) - 49)]


def test_merging_meets_every_interval_that_shards_share(monkeypatch):
    r = random.Random(5)
    shards = []
    for _ in range(4):
        text = b"".join(bytes(r.choice(b"ab") for _ in range(60)) + b"common passage that is rather longer than fifty bytes." for _ in range(3))
        shards.append(bwtmerge.Shard(np.concatenate((np.frombuffer(text, np.uint8) + np.uint8(1), np.zeros(1, np.uint8)))))
    found, starts = bwtmerge.merge(shards)
    assert sorted(np.diff(np.append(starts, len(found))).tolist())[-5:] == [12] * 5


def test_awkward_rows_and_tables(spark):
    rows = [x for x in AWKWARD if x[0] not in (5, 6)]
    assert got(documents(spark, rows)) == plain(rows)
    df = documents(spark)
    assert got(df.limit(0)) == []
    long = {r.doc_id: r for r in bwtmerge.remove_repeats(df).collect()}
    assert long[5].spans == [] and len(long[5].kept) == 150_000 and sha256(bytes(long[6].kept)).hexdigest() == sha256(("é" * 500).encode()).hexdigest()
