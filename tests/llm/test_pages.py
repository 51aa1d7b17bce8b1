import base64
import gzip
import hashlib
import itertools
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from sessionloom.llm import queries, urlrules, warc
from tests.llm.helpers import documents


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, payload string")


ROWS = [
    (1, "https://a.example.com/x", "<p>one</p>"), (2, "https://b.example.com/\r\nX-Page-Id: 9", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "http://c", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"),
    (6, "http://d", "é" * 5000 + "\r\n\r\n"), (7, "http://e", "<p>one</p>"), (8, "http://f", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"),
]


def expect(rows):
    group = {}
    for i, _, h in rows:
        group.setdefault(h or "", []).append(i)
    out = {}
    for i, _, h in rows:
        data, top = (h or "").encode(), max(group[h or ""])
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top)
    return out


def test_archives_round_trip(spark):
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, ROWS)).collect()}
    assert got == expect(ROWS)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_archives_are_read_back_whole(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/w"
    warc.write_archives(pages(spark, ROWS), path, least_bytes=10**9)
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()}
    assert back == {i: h or "" for i, _, h in ROWS}
    assert warc.read_archives(spark, path).filter("not intact").count() == 0
    warc.deduplicate_archives(spark, path, path + "2")
    again = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve_revisits(warc.read_archives(spark, path + "2")).collect()}
    assert again == expect(ROWS)


def test_revisits_of_a_source_archive_are_kept(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/w"
    warc.write_archives(pages(spark, ROWS), path + "/a")  # holds revisits
    more = [(21, "http://g", "<p>one</p>"), (22, "http://h", "<p>two</p>"), (23, "http://i", "<p>one</p>")]
    warc.write_archives(pages(spark, more), path + "/b")
    warc.deduplicate_archives(spark, path, path + "-2")
    back = warc.read_archives(spark, path + "-2")
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve_revisits(back).collect()} == expect(ROWS + more)
    assert back.count() == len(ROWS) + len(more) and back.filter("not intact").count() == 0
    # a second pass changes nothing, nor do small payloads lose their revisits
    warc.deduplicate_archives(spark, path + "-2", path + "-3", least_bytes=10**9)
    assert sorted(map(str, warc.read_archives(spark, path + "-3").collect())) == sorted(map(str, back.collect()))


def test_revisits_without_their_response_are_kept(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/w"
    record = warc._record(F.lit(True), warc._record_id(F.lit(7)), warc._record_id(F.concat(F.col("page_id").cast("string"), F.lit("old"))), "2023-01-01T00:00:00Z")
    rows = spark.createDataFrame([(5, "http://x", "", 10, "AAAA"), (6, "http://y", "", None, None)], "page_id long, url string, payload string, payload_bytes long, payload_digest string")
    warc._write(rows.select(record.alias("value")), path, "gzip", 10)
    warc.deduplicate_archives(spark, path, path + "2")
    first, second = (sorted((r.page_id, r.record_type, r.url, r.refers_to_id, r.stated_digest) for r in warc.read_archives(spark, p).collect()) for p in (path, path + "2"))
    assert first == second and [r[4] for r in first] == ["AAAA", None]


def test_urls_and_given_rules(spark):
    cases = {
        "https://WWW.Example.com/en/1?q#f": ("www.example.com", "/en/1", "www.example.com/en/"), "http://x.example.com/en/": ("x.example.com", "/en/", "example.com/en/"),
        "http://example.com": ("example.com", "", None), "http://a.com/": ("a.com", "/", "com/"), "http://b.net/es/x": ("b.net", "/es/x", "net/es/"), "http://b.net/de": ("b.net", "/de", None),
        "no scheme": ("", "", None), "a://b://c/d": ("b:", "//c/d", None), "http://É.com?x/y": ("É.com", "", None), None: ("", "", None), "http://notexample.com/en/": ("notexample.com", "/en/", "com/"),
    }
    rows = [(i, u, None) for i, u in enumerate(cases)]
    none = spark.createDataFrame([], "url string, blocked boolean")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages(spark, rows), none, queries.URL_RULES).collect()}
    for i, u in enumerate(cases):
        rule = cases[u][2]
        assert out[i] == (*cases[u], queries.URL_RULES[rule] if rule else "allow"), u


def test_mined_rules_match_brute_force(spark):
    urls = [f"http://{h}.example.org/{p}/{i % 3}" for i, (h, p) in enumerate(itertools.product("abcd", ["en", "de", "fr"] * 6))]
    rows = [(u, ("//a." in u and "/de/" in u) or i % 17 == 0) for i, u in enumerate(urls)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    mined = urlrules.mine_rules(labelled, min_support=0.02, min_rows=3, min_confidence=0.7, min_lift=1.5)
    tokens = [set(r.t) for r in labelled.select(urlrules.tokens_of(labelled["url"]).alias("t")).collect()]
    bad, n = [b for _, b in rows], len(rows)
    good = {}
    for size in range(1, 8):
        for c in {c for t in tokens for c in itertools.combinations(sorted(t), size)}:
            hit = [b for t, b in zip(tokens, bad) if set(c) <= t]
            if sum(hit) >= max(0.02 * n, 3) and sum(hit) / len(hit) >= 0.7 and sum(hit) / len(hit) >= 1.5 * sum(bad) / n:
                good[c] = sum(hit) / len(hit)
    want = {c for c, conf in good.items() if not any(set(o) < set(c) and oc >= conf for o, oc in good.items())}
    assert {tuple(r.tokens) for r in mined.collect()} == want and want
    matched = {r.url for r in urlrules.match_rules(labelled.select("url"), mined).collect()}
    assert matched == {u for (u, _), t in zip(rows, tokens) if any(set(c) <= t for c in want)}


def test_deep_urls_are_mined_in_bounded_time(spark):
    for n in (10, 40):
        deep = "http://bad.example.org/" + "/".join(f"f{i}" for i in range(n)) + "/"
        rows = [(f"{deep}{i}", True) for i in range(50)] + [(f"http://good.example.org/x{i % 7}/{i}", False) for i in range(50)]
        labelled = spark.createDataFrame(rows, "url string, blocked boolean")
        began = time.time()
        mined = urlrules.mine_rules(labelled)
        rules = {tuple(r.tokens) for r in mined.collect()}
        assert time.time() - began < 20 and rules == {(t,) for t in ["host:bad.example.org", "label:bad", *[f"dir:f{i}" for i in range(n)]]}
        asked = labelled.select("url").union(spark.createDataFrame([(f"http://other.example.org/f{n - 1}/q",), ("http://other.example.org/q",)], "url string"))
        hit = {r.url for r in urlrules.match_rules(asked, mined).collect()}
        assert hit == {u for u, b in rows if b} | {f"http://other.example.org/f{n - 1}/q"}
        again = urlrules.judge(pages(spark, []), labelled, queries.URL_RULES)
        assert again.count() == 0


def test_hosts_named_like_a_class(spark):
    rows = [(f"http://block.example.org/{'bad' if i % 2 else 'good'}/{i}", i % 2 == 1) for i in range(20)] + [(None, True), ("http://x.org/", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    mined = urlrules.mine_rules(labelled, min_support=0.1, min_rows=3)
    assert {tuple(r.tokens) for r in mined.collect()} == {("dir:bad",)}
    asked = pages(spark, [(i, u, None) for i, (u, _) in enumerate(rows)])
    out = {r.page_id: r.verdict for r in urlrules.judge(asked, labelled, {}, min_support=0.1, min_rows=3).collect()}
    assert out == {i: "block" if i < 20 and i % 2 else "allow" for i in range(len(rows))}
    assert urlrules.judge(pages(spark, []), labelled, queries.URL_RULES).count() == 0


def test_mined_rules_do_not_depend_on_the_share_of_blocked_urls(spark):
    rows = [(f"http://h{i}.org/bad/{i}", True) for i in range(18)] + [(f"http://h{i}.org/good", False) for i in range(4)]
    mined = urlrules.mine_rules(spark.createDataFrame(rows, "url string, blocked boolean"), min_support=0.1, min_rows=3)
    assert ("dir:bad",) in {tuple(r.tokens) for r in mined.collect()}


def test_pages_without_an_id_keep_their_records(spark):
    rows = [(1, "http://a", "x"), (None, "http://b", "x"), (None, "http://c", "y"), (None, "http://d", "y"), (None, None, None)]
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, "response", None), (None, 1, "revisit", 1), (None, 1, "response", None), (None, 1, "response", None), (None, 0, "response", None)], key=str)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/w"
    warc.write_archives(pages(spark, rows), path)
    back = warc.read_archives(spark, path)
    assert back.select("record_id").distinct().count() == 5
    warc.deduplicate_archives(spark, path, path + "-2")
    again = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolve_revisits(warc.read_archives(spark, path + "-2")).collect()), key=str)
    assert again == got


def test_archives_are_read_in_pieces():
    record = lambda n: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n%s\r\n\r\n" % (n + 19, b"z" * n)
    data = b"".join(map(record, (0, 5, 70_000, 1)))
    members = b"".join(gzip.compress(record(n)) for n in (0, 5, 3_000_000))
    for step in (1, 3, 1000, len(data)):
        assert [len(r["payload"]) for r in warc.parse_records(data[i : i + step] for i in range(0, len(data), step))] == [0, 5, 70_000, 1]
    assert [len(r["payload"]) for r in warc.parse_records(warc._unpacked("a.gz", members))] == [0, 5, 3_000_000]
    for broken in (data[:-1], data[:30], b"x" + data):
        with pytest.raises(ValueError):
            list(warc.parse_records(iter([broken])))
    with pytest.raises(ValueError):
        list(warc.parse_records(warc._unpacked("a.gz", members[:-20])))


def test_pipeline_end_to_end(spark):
    import corpus_pipeline

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    text = "The quick brown fox jumps over the lazy dog and runs away from all of the hounds in the morning"
    rows = [(1, text), (2, text), (3, text + " today"), (4, None), (5, "123"), (6, "Write to jane@mail.example.com about the other thing entirely please"), (6, "Write to jane@mail.example.com about the other thing entirely please")]
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "_found"]  # further columns, with names that clash
    documents(spark, rows).selectExpr(*names[:5], "7.5D AS score", "'mine' AS _found").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names and {(r.score, r._found) for r in docs.collect()} == {(7.5, "mine")}
        seen.append(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert [i for i, _ in seen[0]] == [1, 2, 3, 6, 6] and [i for i, _ in seen[1]] == [1, 6]
    assert seen[2][1][1].startswith("Write to [EMAIL] about")
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == {1, 6}


def test_pipeline_of_nothing_and_of_rows_without_ids(spark):
    import corpus_pipeline

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    rows = [(None, "some plain words of a text"), (None, "some plain words of a text"), (1, "some plain words of a text"), (2, "some other words in a text")]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/b/documents.parquet")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, f"{folder}/b").collect()) == ["1", "2", "None", "None"]
