import random
import re
import zlib
from hashlib import sha256

import numpy as np

from sessionloom.llm import periods
from tests.llm.helpers import AWKWARD, documents


def plain_runs(w, least=24, times=3):
    """Runs by comparing words at every distance."""
    n, out = len(w), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j + p - i
            if size >= max(least, times * p) and all(any(w[i + k] != w[i + k + q] for k in range(size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j
    return sorted(out)


def plain(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, size, p in found for i in range(s + p, s + size)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    digest = lambda x: sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{size},{p}\n" for s, size, p in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def words(r, n, kinds):
    return [r.randrange(kinds) for _ in range(n)]


def test_lyndon_arrays_and_runs_match_definitions():
    r = random.Random(5)
    for _ in range(600):
        w = words(r, r.randint(0, 30), r.choice([1, 2, 3, 6]))
        ends = []
        for i in range(len(w)):
            j = i + 1
            while j < len(w) and w[j:] > w[i:]:
                j += 1
            ends.append(j - i)
        assert periods.lyndon(w) == ends
        assert periods.runs(w, 2, 2) == plain_runs(w, 2, 2)


def test_stretches_leave_no_run_out():
    r = random.Random(6)
    for _ in range(200):
        w = []
        for _ in range(r.randint(1, 8)):
            w += words(r, r.randint(1, 25), r.choice([2, 5, 60])) * r.choice([1, 1, 2, 3, 4, 7])
        w = w[: r.randint(1, len(w))]
        found = [(s + a, n, p) for s, e in periods.stretches(np.asarray(w, np.int32), np.zeros(len(w), int)) for a, n, p in periods.runs(w[s:e])]
        assert sorted(found) == plain_runs(w)


def test_runs_of_texts_match_a_loop(spark):
    r = random.Random(7)
    texts = list(AWKWARD)
    for i in range(20, 160):
        said = []
        for _ in range(r.randint(1, 6)):
            said += [f"w{x}" for x in words(r, r.randint(1, 30), r.choice([2, 8, 500]))] * r.choice([1, 1, 3, 5])
        texts.append((i, r.choice([" ", "\n", "\t ", "\x0b"]).join(said)))
    texts.append((500, "no\x1cbreak here  " * 30))
    df = documents(spark, texts)
    found = periods.digests(periods.find(df, plant=True))
    want = [plain(*x) for x in texts if x[0] != 5]
    order = lambda x: (str(x[0]), x[-1])
    assert sorted((tuple(x) for x in found.filter("doc_id is null or doc_id <> 5").collect()), key=order) == sorted(want, key=order)
    long = found.filter("doc_id = 5").first()
    assert long.n_runs >= 1 and long.start == 0 and long.length == 30_000 and long.period == 1


def test_the_smallest_tables_match_a_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: tuple(r) for r in periods.digests(periods.find(docs, plant=True)).collect()}
    some = docs.select("doc_id", "text").collect()
    assert len(found) == len(some) and all(found[r.doc_id] == plain(r.doc_id, r.text) for r in some if len(r.text or "") < 12_000)


def test_empty_tables_and_texts_without_planting(spark):
    df = documents(spark, [(1, "a b " * 30), (2, "c")])
    assert periods.find(df.limit(0)).count() == 0
    found = {r.doc_id: r for r in periods.find(df).collect()}
    assert [tuple(x) for x in found[1].runs] == [(0, 60, 2)] and found[1].collapsed == "a b" and found[2].collapsed == "c" and not found[2].runs


def test_a_text_in_chunks_is_read_like_a_short_one(monkeypatch):
    text = b"one two  three\tfour\n" * 50 + b"x" * 300
    monkeypatch.setattr(periods, "CHUNK", 7)
    book = periods.Words()
    assert book.join(book.read(text)).split() == text.split()
