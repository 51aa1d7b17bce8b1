import difflib
import itertools
import math
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from sessionloom.llm import dartminhash, langid, licenses, mergedropout, pii
from tests.llm.helpers import documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = [f"w{i}" for i in range(400)]


def near(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def classes(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = dict(zip(*map(np.ndarray.tolist, dartminhash.shingles(dartminhash.word_hashes(t)))))
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y:
            low = sum(min(n, y.get(h, 0)) for h, n in x.items())
            if low >= threshold * (sum(x.values()) + sum(y.values()) - low):
                p, q = root(a), root(b)
                least[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for g in range(6):
        base = [rng.choice(WORDS) for _ in range(120)]
        rows += [(100 * g + i, near(rng, base, rng.randint(0, 6))) for i in range(25)]  # similarities on both sides of the threshold
    rows += [(900, None), (901, ""), (902, "..."), (903, "one two"), (904, "One, two!"), (905, "one two three"), (906, "a b c d e " * 400), (907, "a b c d e " * 401), (None, rows[0][1]), (0, rows[0][1])]
    got = dartminhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == classes(rows)
    assert [r.class_id for r in got if r.doc_id is None] == [None]


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(9)
    words = [str(rng.randrange(10**6)) for _ in range(200_000)]
    near, far = list(words), words[:120_000] + [str(rng.randrange(10**6)) for _ in range(80_000)]
    for _ in range(3000):
        near[rng.randrange(len(near))] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, None)]
    assert {r.doc_id: r.class_id for r in dartminhash.near_duplicates(documents(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_duplicates_of_nothing(spark):
    assert dartminhash.near_duplicates(documents(spark, [])).count() == 0


def test_signatures_agree_as_often_as_weighted_sets_are_alike():
    rng = np.random.default_rng(0)
    e, a = rng.integers(0, 2**63, 40).astype(np.uint64), rng.random(40) * 3 + 0.01
    b = a.copy()
    b[:12] *= 0.3
    s = dartminhash.signatures([e, e], [a, b], 8000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def naive_base(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("a@.1 -+2(5é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == naive_base(t), t


def test_long_runs_take_linear_time():
    for t in ["1" * 300_000, "@" * 300_000, "a" * 300_000 + "@", "a@b" * 100_000, "+1" + " " * 300_000, "1." * 150_000]:
        assert pii.base_spans(t) is not None


def test_weak_supervision_adds_secrets_and_leaves_decoys(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        hexes, number = "".join(rng.choice("0123456789abcdef") for _ in range(40)), "".join(rng.choice("0123456789") for _ in range(16))
        rows.append((i, f'Some words token = "{hexes}" then mail a{i}@b.example.com and page {number} of it' if i % 2 else f"clean text number {number} The End"))
    out = {r.doc_id: r for r in pii.find(documents(spark, [*rows, (1000, None), (1001, "")])).collect()}
    assert all(("secret:" in out[i].spans) == (i % 2 == 1) for i in range(400))
    assert out[1].n_email == 1 and out[1000].spans == out[1001].spans == ""
    model = pii.fit(pii.scan(documents(spark, rows)))
    assert set(model.reliability) == set(pii.LABELERS)
    text = pii.redact(documents(spark, [(1, rows[1][1]), (2, None), (3, "")]), model).orderBy("doc_id").collect()
    assert "[SECRET]" in text[0].text and "[EMAIL]" in text[0].text and "@" not in text[0].text and text[1].text is None and text[2].text == ""


def test_added_kinds_have_precision_and_recall(spark):
    rng = random.Random(6)
    given, family = sorted(pii.GIVEN_NAMES), sorted(pii.FAMILY_NAMES)
    token = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    digits = lambda n: token(n, "0123456789")
    planted = {
        "name": lambda: (rng.choice(["we met ", "a letter from Dr. ", "mit Frau ", "le livre de "]), f"{rng.choice(given)} {rng.choice(family)}"),
        "number": lambda: (rng.choice(["phone: ", "Tel. ", "call ", "SSN "]), f"{digits(3)}-{digits(3)}-{digits(4)}"),
        "secret": lambda: rng.choice([("password=", token(18, "0123456789abcdef")), ('token = "', token(40, "0123456789abcdef")), ("using ", "AKIA" + token(16, "ABCDEFGHJKLMNPQRSTUVWXYZ234567"))]),
    }
    decoys = [
        lambda: f"at {rng.choice(['The', 'Der', 'Las', 'New'])} {token(1, 'ABCD')}{token(6, 'aeioulmn')} ", lambda: f"on page {digits(9)} of it", lambda: f"dated 20{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} then",
        lambda: f"in version {digits(1)}.{digits(2)}.{digits(3)} now", lambda: f"{token(1, 'STRW')}{token(7, 'aeioulmn')} {token(1, 'STRW')}{token(7, 'aeioulmn')} went on", lambda: "isbn 978-3-16-148410-0 ", lambda: f"commit {token(40, '0123456789abcdef')} ",
    ]
    rows, want = [], {}
    for doc in range(900):
        text, want[doc] = "", set()
        for _ in range(rng.randint(2, 5)):
            text += rng.choice(["some plain words ", "einige Wörter ", "unas palabras, "])
            if rng.random() < 0.4:
                kind = rng.choice(sorted(planted))
                before, span = planted[kind]()
                want[doc].add((kind, len(text + before), len(text + before + span)))
                text += before + span + ('" ' if before.endswith('"') else " ")
            else:
                text += rng.choice(decoys)()
        rows.append((doc, text))
    got = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    for kind in pii.ADDED:
        found = {(i, *map(int, s.split(":")[1:])) for i, r in got.items() for s in r.spans.split(",") if s.startswith(kind)}
        real = {(i, a, b) for i, spans in want.items() for k, a, b in spans if k == kind}
        assert len(found & real) >= 0.9 * len(real) and len(found & real) >= 0.9 * len(found), (kind, len(found), len(real), len(found & real))
        assert sum(r[f"n_{kind}"] for r in got.values()) == len(found)
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in got.values())


def test_personal_data_of_nothing(spark):
    assert pii.find(documents(spark, [])).count() == 0
    assert pii.find(documents(spark)).count() == documents(spark).count()


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, langid.fold("id") != 2)
    found = langid.identify(docs.withColumnRenamed("lang", "truth"), model).filter(langid.fold() == 2).collect()
    assert sum(r.lang_pred == r.truth for r in found) >= 0.97 * len(found)


def test_decoding_matches_a_plain_one():
    rng = np.random.default_rng(2)
    codes = langid.codewords(4)
    model = langid.LanguageModel(list("abcd"), codes, rng.normal(size=(1 << langid.BUCKET_BITS, codes.shape[1])), rng.normal(size=codes.shape[1]), rng.random(codes.shape[1]))
    counts = rng.integers(0, 3, (20, 1 << langid.BUCKET_BITS))
    for row, best, share, lead in zip(counts, *model.predict(counts), strict=True):
        x = [math.sqrt(n) for n in row.tolist()]
        size = math.sqrt(sum(v * v for v in x))
        margin = [sum(v / size * w for v, w in zip(x, model.weights[:, b].tolist())) + model.bias[b] for b in range(codes.shape[1])]
        lost = [sum(t * math.log1p(math.exp(-langid.SLOPE * m * c)) for t, m, c in zip(model.trust, margin, code)) for code in codes]
        shares = sorted((math.exp(-v) / sum(math.exp(-u) for u in lost), i) for i, v in enumerate(lost))
        assert best == shares[-1][1] and abs(share - shares[-1][0]) < 1e-4 and abs(lead - (shares[-1][0] - shares[-2][0])) < 1e-4


def test_language_of_odd_texts(spark):
    rows = [(1, "the cat and the dog"), (2, None), (3, "123 ..."), (4, "der hund und die katze"), (5, "the " * 50_000), (None, "the end")]
    model = langid.fit(documents(spark, [(i, t) for i, t in rows if t]).selectExpr("doc_id", "text", "if(text like 'der%', 'de', 'en') AS lang"), langid.fold("id") >= 0)
    out = {r.doc_id: r for r in langid.identify(documents(spark, rows), model).collect()}
    assert out[2].lang_pred == out[3].lang_pred == "und" and out[2].score == 0 and out[4].lang_pred == "de" and out[5].lang_pred == "en"
    assert langid.identify(documents(spark, []), model).count() == 0
    nothing = langid.fit(documents(spark, []), langid.fold("id") >= 0)
    assert {r.lang_pred for r in langid.identify(documents(spark, rows), nothing).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n


TEXTS = ["", " ", "  a  b\n c d ", "añ\tb日\x00 x", "日本語 テキスト", "\n\n", "Unbelievable internationalisation of thonanonthe words", "word " * 300, "😀 ok"]


def test_without_dropout_the_model_s_own_pieces():
    own, sp = mergedropout.DropoutEncoder(MODEL, 0.0, 1), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [x.tolist() for x in own.encode(TEXTS, list(range(len(TEXTS))))] == sp.encode(TEXTS)


def naive_dropout(own, chunk, variant):
    """One chunk through a plain agenda."""
    sym = [int(own.char_ids[ord(c)]) if own.char_ids[ord(c)] >= 0 else ~ord(c) for c in chunk]
    start = list(range(len(sym)))
    mix = lambda x: mergedropout._mix(np.array([x % 2**64], np.uint64))
    m = [int(x) for x in mergedropout._M]
    key = int(mix((sum(int(mix(ord(c) + (i + 1) * m[0] + own.seed * m[2])[0]) for i, c in enumerate(chunk)) + variant * m[1]))[0])
    while True:
        best = None
        for i in range(len(sym) - 1):
            if sym[i] >= 0 and sym[i + 1] >= 0:
                got = own.merged(sym[i], sym[i + 1])
                if got >= 0 and int(mix(key + start[i] * m[0] + got * m[2])[0]) >= int(own.skip_below):
                    best = min(best or (2**62, 0, 0), (int(own.rank[got]), i, got))
        if best is None:
            break
        sym[best[1] : best[1] + 2] = [best[2]]
        del start[best[1] + 1]
    return [b for s in sym for b in ([s] if s >= 0 else [int(own.byte_ids[x]) for x in chr(~s).encode()])]


def test_agenda_matches_a_plain_one():
    own = mergedropout.DropoutEncoder(MODEL, 0.3, 5)
    chunks = [(c, v) for c in (" internationalisation", " thonanonthe", "日本x", " añ", "\n", " aaaaaaaaaaaa") for v in range(4)]
    assert [np.frombuffer(x, "<i4").tolist() for x in own.agenda(chunks)] == [naive_dropout(own, c, v) for c, v in chunks]


def test_long_chunks_take_the_same_agenda():
    own = mergedropout.DropoutEncoder(MODEL, 0.2, 5)
    rng = random.Random(2)
    chunks = ["".join(rng.choice("abcdethéx日 "[: 11 - n % 2]).replace(" ", "e") for _ in range(rng.randint(1, 90))) for n in range(60)]
    assert [np.frombuffer(x, "<i4").tolist() for x in own.agenda([(c, i) for i, c in enumerate(chunks)])] == [naive_dropout(own, c, i) for i, c in enumerate(chunks)]
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_000_000))
    began = time.monotonic()
    ids, each = own.encode_all(["the", text, "end"], [1, 2, 3])
    assert time.monotonic() - began < 60 and own.lossless(["the", text, "end"], ids, each).all()


def test_pair_tables_answer_as_dictionaries():
    rng = random.Random(4)
    pairs = {(min(rng.randrange(300), rng.randrange(300)), rng.randrange(300)): rng.randrange(10**6) for _ in range(4000)}
    table = mergedropout.PairTable(pairs, 302)
    left, right = np.repeat(np.arange(302), 302), np.tile(np.arange(302), 302)
    assert table.get(left, right).tolist() == [pairs.get((a, b), -1) for a, b in zip(left.tolist(), right.tolist(), strict=True)]


def test_dropout_varies_and_decodes_losslessly(spark):
    docs = documents(spark)
    rows = mergedropout.encode_documents(docs, MODEL, dropout=0.2).collect()
    assert len(rows) == docs.count() and all(r.lossless for r in rows)
    again = mergedropout.encode_documents(docs, MODEL, dropout=0.2, seed=2).collect()
    assert {r.doc_id: r.ids for r in rows}[5] != {r.doc_id: r.ids for r in again}[5]
    own = mergedropout.DropoutEncoder(MODEL, 0.2, 1)
    ids = own.encode(["internationalisation " * 50], [3])[0]
    assert len({tuple(own.agenda([(" internationalisation", v)])[0]) for v in range(4)}) > 1 and own.decode(ids) == "internationalisation " * 50
    decoded = {r.doc_id: r.text for r in mergedropout.decode_documents(mergedropout.encode_documents(docs, MODEL), MODEL).collect()}
    assert decoded == {r.doc_id: r.text or "" for r in docs.collect()}
    assert mergedropout.encode_documents(documents(spark, []), MODEL).count() == 0


def test_licenses_and_their_differences(spark):
    rows = [
        (1, "Foo bar. Released under the MIT License. ok"), (2, "x " * 400 + "This work is licensed under the GNU General Public License, version 2. " + "y " * 400),
        (3, "this work was licensed under the GNU General Public Licence, version 3"), (4, "You need a driver license to drive"), (5, None), (6, ""),
        (7, "Released under the MIT License. some words " * 200), (8, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
    ]
    out = licenses.scan(documents(spark, rows)).orderBy("doc_id", "start").collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.license, r.exact) for r in by[1]] == [("MIT", True)] and rows[0][1][by[1][0].start : by[1][0].end] == "Released under the MIT License"
    assert [(r.license, r.exact) for r in by[2]] == [("GPL-2.0", True)]
    assert by[3][0].license == "GPL-3.0" and not by[3][0].exact and "license->licence" in by[3][0].differences
    assert len(by[7]) == 200 and all(r.license == "MIT" and r.exact for r in by[7])
    assert [r.license for r in by[8]] == ["CC-BY-NC-4.0", "Apache-2.0"] and not {4, 5, 6} & set(by)
    assert licenses.scan(documents(spark, [])).count() == 0
    assert {r.doc_id: r.n_found for r in licenses.verdicts(documents(spark, rows)).collect()}[7] == 200


@pytest.mark.parametrize("mark", ["\n", "\n * ", "\r\n# "])
def test_wrapped_licenses_of_every_template(spark, mark):
    names = sorted(licenses.TEMPLATES)
    wrap = lambda t, n: mark.join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [(10 * i + n, "Some words before\n\n" + wrap(licenses.TEMPLATES[name], n) + "\n\nand words after") for i, name in enumerate(names) for n in (1, 2, 4, 7)]
    rows.append((1000, "\n\n".join(wrap(licenses.TEMPLATES[name], 5) for name in names)))
    got = {}
    for r in licenses.scan(documents(spark, rows)).orderBy("start").collect():
        got.setdefault(r.doc_id, []).append((r.license, r.exact))
    assert got == {**{10 * i + n: [(name, True)] for i, name in enumerate(names) for n in (1, 2, 4, 7)}, 1000: [(name, True) for name in names]}


def test_templates_of_a_caller_need_no_word_of_licensing(spark):
    own = {"Tea": "Whoever drinks this tea shall wash every cup before sunset", "Long": " ".join(f"term{i} and" for i in range(150))}
    rows = [(1, "Hello. Whoever drinks this coffee shall wash every cup before sunset! Bye."), (2, "x " * 90 + own["Long"] + " y" * 90), (3, "Whoever washes a cup")]
    got = licenses.scan(documents(spark, rows), templates=own).collect()
    assert sorted((r.doc_id, r.license, r.exact) for r in got) == [(1, "Tea", False), (2, "Long", True)]


def test_licenses_match_every_template_at_every_stretch(spark):
    rng = random.Random(8)
    fixed = {k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}

    def held(text, want):
        words, most, n = licenses.words_of(text), 0, len(want)
        for i in range(len(words)):  # every stretch that is about as long
            runs = difflib.SequenceMatcher(None, want, words[i : i + n + 3], autojunk=False).get_matching_blocks()
            most = max(most, sum(r.size for r in runs))
        return most / n

    rows = []
    for doc in range(45):
        name = sorted(fixed)[doc % len(fixed)]
        words = licenses.TEMPLATES[name].split()
        for _ in range(round(rng.choice((0, 0.1, 0.5)) * len(words))):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        fill = lambda: " ".join(rng.choice([*WORDS, "license", "software"]) for _ in range(rng.randint(0, 40)))
        rows.append((doc, f"{fill()} {' '.join(words)} {fill()}"))
    got = {}
    for r in licenses.scan(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for doc, text in rows:
        share = {name: held(text, want) for name, want in fixed.items()}
        sure = {name for name, x in share.items() if x >= 0.8}
        assert got.get(doc, set()) <= sure and bool(got.get(doc)) == bool(sure), (doc, share)
        if sure:
            best = max(sure, key=lambda name: share[name] ** 2 * len(fixed[name]))
            assert best in got[doc], (doc, got[doc], sure)


def test_licenses_in_overlapping_windows_count_once(spark):
    notice = licenses.TEMPLATES["GPL-notice"].replace(" ", "\n", 20)
    text = ("Copyright holders " + "word " * 37) * 40
    rows = [(n, text[: 11 * n] + "\n" + notice + "\n" + text) for n in range(0, 300, 25)]
    assert {r.doc_id: (r.license, r.exact) for r in licenses.scan(documents(spark, rows)).collect()} == {n: ("GPL-notice", True) for n, _ in rows}
    assert licenses.scan(documents(spark, rows)).count() == len(rows)


def test_every_occurrence_draws_its_own_skips(spark):
    word, n = " internationalisation", 2000
    own = mergedropout.encoder(MODEL, 0.1, 1)
    rows = mergedropout.encode_documents(documents(spark, [(i, word[1:] + word * (n - 1)) for i in range(2)]), MODEL).orderBy("doc_id").collect()
    ways = []
    for r in rows:
        ways.append([])
        name = mergedropout.xxhash.xxh3_64_intdigest(str(r.doc_id), seed=1)
        at = 0
        for i in range(n):
            draw = int(mergedropout._mix(np.array([(i * int(mergedropout._M[0]) + name) % 2**64], np.uint64))[0])
            want = naive_dropout(own, word, draw) if i < 10 else np.frombuffer(own.agenda([(word, draw)])[0], "<i4").tolist()
            assert r.ids[at : at + len(want)] == want
            at += len(want)
            ways[-1].append(tuple(want))
        assert at == len(r.ids) and r.lossless
    assert len(set(ways[0])) > 4 and ways[0] != ways[1]


def test_texts_take_the_agenda_chunk_by_chunk():
    own = mergedropout.DropoutEncoder(MODEL, 0.3, 5)
    texts = [t * 20 for t in TEXTS] + ["aaaaaaaa " * 30, "a" * 90, "\u2581x\u2581the " * 9]
    for _ in range(2):
        for name, (text, got) in enumerate(zip(texts, own.encode(texts, list(range(len(texts)))), strict=True)):
            chunks = re.findall(r" +[^ \n]*|\n|[^ \n]+", " " + text) if text else []
            draws = mergedropout._mix(np.arange(len(chunks), dtype=np.uint64) * mergedropout._M[0] + np.uint64(name)).tolist()
            assert got.tobytes() == b"".join(own.agenda(list(zip(chunks, draws, strict=True))) if chunks else [])


def test_compression_decides_between_templates(monkeypatch):
    fixed = tuple(sorted(licenses.TEMPLATES.items()))
    names = ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "GPL-notice", "AGPL-notice", "MIT-notice", "MIT-text")
    block = lambda name: "as they say " + licenses.TEMPLATES[name] + " and so on"
    assert [[h[0] for h in licenses.classify(block(n), fixed)] for n in names] == [[n] for n in names]
    for n in names:
        assert n in licenses.ranked(" ".join(licenses.words_of(block(n))).encode(), fixed)[:2]  # a notice is in the whole text as well

    class Same:
        def compress(self, data):
            return b"x" * 10

    own = {name: (Same(), words) for name, (_, words) in licenses._compressors(fixed)[1].items()}
    monkeypatch.setattr(licenses, "_compressors", lambda templates: (Same(), own))
    assert [[h[0] for h in licenses.classify(block(n), fixed)] for n in names] != [[n] for n in names]
