import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from sessionloom.llm import merkle
from tests.llm.helpers import AWKWARD, documents


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def said(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows):
    """Each row's (leaf, subroot, root, proof, folded root), by one tree a source in plain loops."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    leaf = lambda r, text: said(r["doc_id"], r["source"], r["lang"], r["n_chars"], text)

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([h(*found[-1][i : i + 3]) for i in range(0, len(found[-1]), 3)])
        return found

    def climb(tree, at, digest):
        sides = []
        for nodes in tree[:-1]:
            run = nodes[at - at % 3 : at - at % 3 + 3]
            others = run[: at % 3] + run[at % 3 + 1 :]
            digest = h(*others[: at % 3], digest, *others[at % 3 :])
            sides += others
            at //= 3
        return digest, sides

    trees = {}
    for g, its in groups.items():
        its.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[g] = levels([leaf(r, r["text"]) for r in its])
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for g, its in groups.items():
        for i, r in enumerate(its):
            even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            text = r["text"].replace("\n", "") if even and r["text"] is not None else r["text"]
            sub, sides = climb(trees[g], i, leaf(r, text))
            root, more = climb(top, names.index(g), sub)
            out.append((str(r["doc_id"]), leaf(r, r["text"]), trees[g][-1][0], top[-1][0], h(*sides, *more), root, root == top[-1][0]))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.document_manifest(df).collect())


def test_manifest_matches_plain_trees(spark):
    rows = [(i, f"line {i}\nmore" if i % 3 else f"one line {i}", "en" if i % 5 else None, "hot" if i % 2 else f"s{i % 40}", i) for i in range(900)]
    rows += [(5000 + i, None, None, None, None) for i in range(4)] + [(None, "no id\n", "en", "hot", 1), (7, "again\n", "en", "hot", 1), (7, "again\n", "en", "hot", 1), (9000, "a\n\nb", "é", "日本", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert got(df) == plain([r.asDict() for r in df.collect()])


def test_blocks_of_any_height_give_the_same_tree(spark, monkeypatch):
    rows = [(i, f"{i}\n", "en", "a" if i < 140 else f"b{i % 12}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = plain([r.asDict() for r in df.collect()])
    base = [(chr(97 + i % 26) * 64) for i in range(140)]
    # blocks of three levels, folded again and again, end in the root of one block of eight
    nodes, total = base, len(base)
    while total > 1:
        blocks = [merkle.levels_of(nodes[i : i + 27], total, 3)[-1][0] for i in range(0, len(nodes), 27)]
        nodes, total = blocks, -(-total // 27)
    assert nodes == merkle.levels_of(base, len(base), 8)[-1]
    assert got(df) == want


def test_a_version_copies_ancestors_only(spark):
    rows = [(i, f"{i}\n", "en", f"s{i % 4}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.manifest(merkle.tampered(df)).collect()
    base = {r.leaf for r in found}
    for r in found:
        # 15 leaves a source are 3 levels, 4 sources are 2
        assert len(r.copies) == (6 if zlib.crc32(r.row.encode()) % 2 == 0 else 0)
        assert r.verified == (not r.copies) and (not r.copies or r.copies[-1] == r.folded_root and not set(r.copies) & base)


def test_awkward_rows_and_tables(spark):
    df = documents(spark, AWKWARD)
    assert got(df) == plain([r.asDict() for r in df.collect()])
    assert merkle.document_manifest(df.limit(0)).count() == 0
    one = df.filter("doc_id = 1")
    r = merkle.document_manifest(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h()


def test_places_are_those_of_a_window(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 100).alias("x"), F.col("id").cast("string").alias("y"))
    rows = sorted((r.g, r.x, r.y) for r in df.collect())
    place, want = {}, []
    for g, x, y in rows:
        want.append((g, x, y, place.get(g, 0)))
        place[g] = place.get(g, 0) + 1
    found = merkle.ranked(df, "g", "x", "y").collect()
    assert sorted((r.g, r.x, r.y, r.idx) for r in found) == want and all(r.n == place[r.g] for r in found)
