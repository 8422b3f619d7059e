"""The WARC store, hard-negative mining and the filter audit against plain versions, and their edge cases."""

import base64
import gzip
import hashlib
import itertools
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import filter_audit, hard_negatives, warc_store
from quarry.llm.shared import Scratch

# ---- WARC store

PAGES = "page_id long, url string, html string, header string, address string"
TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\nWARC/1."


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


def plain_archive(rows, min_bytes=0):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        holder = top.get(h or "") if len(body) >= min_bytes else i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == holder else "revisit", None if i == holder else holder))
    return Counter(out)


ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://b/\r\nPage-Id: 77", None), (4, "", ""), (5, "u", TRICKY), (6, "u", TRICKY + "\r\n"), (7, "u", "\r\n\r\n"), (7, "u", "\r\n\r\n"),
    (8, "u", "\r\n\r\n"), (-3, "u", "ä" * 70_000), (None, "u", "nobody's"), (None, "u", "<p>same</p>"), (20, "u", "twice"), (20, "v", "twice"), (21, "u", "x\r\n" * 50_000),
]


@pytest.mark.parametrize("sent,parts", [(200_000, 1), (0, 3)])
def test_archive_equals_plain(spark, monkeypatch, sent, parts):
    monkeypatch.setattr(warc_store, "SENT", sent)
    got = warc_store.archive(pages(spark, ROWS).repartition(parts))
    assert Counter(tuple(r) for r in got.collect()) == plain_archive(ROWS)


def test_archive_small_payloads_and_empty_table(spark):
    assert Counter(tuple(r) for r in warc_store.archive(pages(spark, ROWS), min_bytes=8).collect()) == plain_archive(ROWS, 8)
    assert warc_store.archive(pages(spark, [])).collect() == []


def test_store_gives_back_the_bytes_of_the_files(spark):
    scratch = Scratch(spark, "test-warc")
    path = f"{scratch.home}/archives"
    warc_store.write_archives(pages(spark, ROWS).repartition(2), path, scratch)
    headers, payloads = warc_store.store(spark, path, scratch)
    assert payloads.count() == payloads.select("address").distinct().count() == len({h or "" for _, _, h in ROWS})
    whole = warc_store.restore(headers, payloads, scratch, least=2).collect()
    assert all(r["payload"] is not None for r in whole) and Counter(r["page_id"] for r in whole) == Counter(i for i, _, _ in ROWS)
    held = {}
    for r in sorted(whole, key=lambda r: (r["file"], r["record"])):
        body = bytes(r["payload"]) if r["record_type"] == "response" else b""
        held[r["file"]] = held.get(r["file"], b"") + bytes(r["header"]) + bytes(r["http_header"]) + body + b"\r\n\r\n"
    files = [f for f in Path(path.removeprefix("file://")).glob("*.gz")]
    there = {f.name: gzip.decompress(f.read_bytes()) for f in files}
    assert {k.rsplit("/", 1)[1]: v for k, v in held.items()} == {k: v for k, v in there.items() if v}
    for body in there.values():
        ids = re.findall(rb"WARC-Type: revisit\r\nWARC-Record-ID: (\S+)", body)
        assert all(x.startswith(b"<urn:uuid:") for x in ids)


def test_store_finds_false_payloads(spark):
    scratch = Scratch(spark, "test-warc")
    path = f"{scratch.home}/archives"
    warc_store.write_archives(pages(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "other")]), path, scratch)
    headers, payloads = warc_store.store(spark, path, scratch)
    forged = payloads.withColumn("payload", F.when(F.octet_length("payload") == 3, F.lit("abd").cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="payload is not what its record states"):
        warc_store.restore(headers, forged, scratch).collect()
    gone = warc_store.restore(headers, payloads.where(F.octet_length("payload") > 3), scratch)
    assert sorted((r["page_id"], r["payload"] is None) for r in gone.collect()) == [(1, True), (2, True), (3, False)]


def test_framer_takes_any_pieces_and_refuses_cut_files():
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\r\n\r\n"
    for size in (1, 3, 7, 100):
        framer, out = warc_store.Framer(), []
        stream = record * 4
        for s in range(0, len(stream), size):
            out += framer.feed(stream[s : s + size])
        framer.end()
        assert [b for _, b in out] == [b"ab\r\n\r"] * 4
    framer = warc_store.Framer()
    assert list(framer.feed(record[:-6])) == []
    with pytest.raises(ValueError, match="within a record"):
        framer.end()
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc_store.Framer().feed(b"HTTP/1.1 200\r\n\r\n"))


# ---- hard negatives


def plain_mine(rows, anchors, positives=5, negatives=5, low=80):
    live = []
    for n, (i, v, lab) in enumerate(rows):
        if i is None or lab is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        live.append((n, i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab))
    out = []
    for n, i, v, lab in live:
        if not anchors(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for k, j, w, m in live if k != n]
        best = sorted(x[:2] for x in scored if x[2] == lab)[:positives]
        for s, j in best:
            fit = sorted(x[:2] for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1.0) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, row string, score double")


def clustered(seed, n=400, width=8, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, width))
    at = rng.integers(0, clusters, n)
    return [(int(i), (centres[at[i]] + 0.3 * rng.standard_normal(width)).astype(np.float32).tolist(), int(rng.integers(0, 3) if i % 3 else at[i] % 3)) for i in range(n)]


@pytest.mark.parametrize("shard,chunk", [(4096, 256), (50, 4), (7, 2)])
def test_mine_equals_plain(spark, shard, chunk):
    rows = clustered(shard)
    rows += [(10, [0.5] * 8, 1), (10, [0.5] * 8, 1), (30, [0.5] * 8, 2), (31, [0.5] * 8, 2)] + [(1000 + i, [0.25] * 8, i % 2) for i in range(60)]
    rows += [(None, [1.0] * 8, 0), (40, None, 1), (50, [1.0, None] * 4, 1), (60, [float("nan")] * 8, 1), (70, [float("inf")] * 8, 1), (80, [1.0] * 8, None), (90, [], 1), (100, [2.0, 1.0], 1), (110, [0.1] * 200, 2)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, shard=shard, chunk=chunk)
    want = plain_mine(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and Counter(tuple(r) for r in got.collect()) == want


def test_mine_edges(spark):
    assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    alone = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)]  # no positive
    assert hard_negatives.mine(vectors(spark, alone), F.col("vec_id") == 0).collect() == []
    against = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-1.0, 0.0], 2), (3, [0.0, 1.0], 2)]  # a positive of a negative score
    assert hard_negatives.mine(vectors(spark, against), F.col("vec_id") == 0).collect() == []
    zero = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 5.0], 2), (3, [1e-3, 1.0], 2)]
    assert [tuple(r) for r in hard_negatives.mine(vectors(spark, zero), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)]


def trees(rng, n, width, labels, spread):
    m = np.floor(256 * (rng.integers(0, 4, (n, 1)) * 1.0 + spread * rng.standard_normal((n, width))))
    lab = rng.integers(0, labels, n).astype(np.int64)
    order, nodes = hard_negatives.grow(m, lab, 8)
    rows = np.arange(n)[order]
    return hard_negatives.boxed(rows + 1000, rows, lab[order], m[order], nodes)


def test_trees_prune_groups_of_anchors_and_lose_nothing():
    rng = np.random.default_rng(5)
    a, b = trees(rng, 40, 4, 2, 0.05), trees(rng, 600, 4, 2, 0.05)
    for t in (a, b):
        for (start, stop, left, right), lo, hi, first, last in zip(t.nodes, t.lo, t.hi, t.label_lo, t.label_hi):
            assert (t.matrix[start:stop] >= lo).all() and (t.matrix[start:stop] <= hi).all() and set(t.labels[start:stop]) <= set(range(first, last + 1))
            assert left < 0 or (t.nodes[left, 0], t.nodes[left, 1], t.nodes[right, 1]) == (start, t.nodes[right, 0], stop)
    tasks = np.array([[r, 0, hard_negatives.FLOOR, 200_000] for r in a.rows], np.int64)
    found, scored = hard_negatives.search(a, b._replace(rows=b.rows + 10_000), tasks, False, 3)
    leaves = [(x.nodes[:, 2] < 0).sum() for x in (a, b)]
    assert scored < leaves[0] * leaves[1] / 2
    for i, row in enumerate(a.rows):
        s = b.matrix @ a.matrix[i]
        good = [(-x, j) for x, j, lab in zip(s, b.ids, b.labels) if lab != a.labels[i] and x <= 200_000]
        assert [(-s, i) for r, _, i, s in found if r == row] == [(x, j) for x, j in sorted(good)[:3]]
    low, high = hard_negatives.intervals(a.lo[:1], a.hi[:1], b.lo[:1], b.hi[:1])
    every = a.matrix @ b.matrix.T
    assert low[0] <= every.min() and every.max() <= high[0]


# ---- filter audit

DOCS = "doc_id long, text string, source string, mask int, class long, part string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "z") for i, t, s in rows], DOCS)


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, part string")


def plain_masks(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t) is not None, i is not None and i > least[t])
        yield i, s or "", sum(1 << k for k, x in enumerate(tests) if x)


def plain_audit(rows, labels):
    told = {}
    for i, q, t, *_ in labels:
        old = told.get(i, (0, 0))
        told[i] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    told.pop(None, None)
    parts = {}
    for i, s, mask in plain_masks(rows):
        parts.setdefault(s, []).append((mask, *told.get(i, (0, 0))))
    out = []
    for part, held in parts.items():
        of_filter, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = held
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [x for x in left if x[0] & bit]
                left = [x for x in left if not x[0] & bit]
                failing = sum(1 for x in held if x[0] & bit)
                of_filter[letter] += len(gone)
                lines.append((letter, ("".join(order), step, len(left), len(gone), failing - len(gone), sum(1 for x in held if x[0] == bit), sum(x[1] for x in gone), sum(x[2] for x in gone))))
        out += [(part, *line, of_filter[letter]) for letter, line in lines]
    return Counter(out)


def audit_rows():
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("w%d" % x for x in rng.integers(0, n, n))
    long = "ä" * 3000 + word(300)
    rows = [(i, word(int(rng.integers(20, 120))) + rng.choice(["", " #", " ABCDEFGHIJKLMNOPQ"]), rng.choice(["s1", "s2"]) if i % 9 else None) for i in range(60)]
    rows += [(100 + i, rows[i][1], "s3") for i in range(0, 30, 2)] + [(200 + i, long + ("x" if i % 2 else "y"), "s1") for i in range(8)] + [(300, long[:-1] + "zz", "s1")]
    rows += [(None, rows[0][1], "s1"), (None, None, "s2"), (400, None, "s2"), (401, "", "s2"), (401, "", "s2"), (402, " \t\r\n", ""), (5, rows[5][1], "s4"), (-7, rows[6][1], "s4"), (500, " A\x0bB\x0c\x1cC", "s5")]
    return [(i, t, None if s is None else str(s)) for i, t, s in rows]


LABELS = [(i, i % 2, int(i % 5 == 0), "p") for i in range(0, 60)] + [(3, 0, 1, "p"), (101, None, 1, "p"), (None, 1, 1, "p"), (9999, 1, 1, "p")]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_audit_equals_plain(spark, monkeypatch, sent):
    monkeypatch.setattr(filter_audit, "SENT", sent)
    rows = audit_rows()
    got = Counter(tuple(r) for r in filter_audit.audit(docs(spark, rows), marks(spark, LABELS)).collect())
    assert got == plain_audit(rows, LABELS)


def test_audit_compares_whole_texts_when_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "_blocks", lambda text: F.array(F.lit(1).cast("long")))
    rows = audit_rows()
    assert Counter(tuple(r) for r in filter_audit.audit(docs(spark, rows), marks(spark, LABELS)).collect()) == plain_audit(rows, LABELS)


def test_audit_refines_block_by_block(spark):
    scratch = Scratch(spark, "test-audit")
    texts = [(1, "a" * 5000 + "x"), (2, "a" * 5000 + "y"), (3, "b" * 5001), (4, "a" * 5000 + "x"), (5, "short"), (6, "other")]
    df = spark.createDataFrame(texts, "id long, text string")
    rows = df.select("id", F.length("text").alias("n_chars"), filter_audit._blocks(F.col("text")).alias("blocks"))
    assert sorted(r["id"] for r in filter_audit.refined(scratch, rows).collect()) == [1, 4]
    assert {len(r["blocks"]) for r in rows.where("id < 5").collect()} == {4}


def test_audit_empty_tables(spark):
    assert filter_audit.audit(docs(spark, []), marks(spark, LABELS)).collect() == []
    got = filter_audit.audit(docs(spark, [(1, "a", "s")]), marks(spark, [])).collect()
    assert len(got) == 600 and {r["good_lost"] for r in got} == {0}


# ---- the registered queries


@pytest.mark.parametrize("name", ["op11_warc_archive", "op12_hard_negatives", "op13_filter_audit"])
def test_query_equals_oracle(spark, name):
    import duckdb

    from quarry.llm.queries import ORACLES, QUERIES

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = QUERIES[name](spark, data)
    names = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want)
