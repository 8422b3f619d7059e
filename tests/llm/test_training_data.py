"""The training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in is it on for was a be as with at".split()


def prose(rng, n, end="."):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choice(["th", "er", "in", "on", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + end


def docs_frame(spark, rows):
    """Extra columns whose names clash with what operators make."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, n_words int")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(25, 90)) for _ in range(14)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0] + " tail"), (22, base[1][:80] + " " + base[2] + "\n" + base[2]), (23, None), (24, ""), (25, "one"), (26, "two words"), (27, " \t\n "), (28, "é " * 3000), (29, base[3]), (29, base[3]), (None, base[4]), (30, "To " * 100)]
    return rows


# ---- quality rules


def brute_measures(t):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = (t or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            cover |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(cover)


def test_quality_rules_measures_and_base(spark, texts):
    from quarry.llm.quality_rules import assess

    got = assess(docs_frame(spark, texts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for i, t in texts:
        m = brute_measures(t)
        want.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    key = lambda r: str(r)
    assert sorted([tuple(r)[:-1] for r in got], key=key) == sorted(want, key=key)
    assert not any(r.kept and r.base_failed for r in got)
    assert assess(docs_frame(spark, [])).count() == 0


def test_quality_rules_tell_junk(spark):
    from quarry.llm.quality_rules import assess, keep_good

    rng = random.Random(1)
    good = [(i, prose(rng, 120)) for i in range(60)]
    junk = [(100 + i, " ".join(w + "###" for w in prose(rng, 100).split())) for i in range(6)] + [(200 + i, prose(rng, 100).upper().replace(" ", "!! ")) for i in range(6)]
    frame = docs_frame(spark, good + junk)
    kept = {r.doc_id for r in assess(frame).where("kept").collect()}
    assert kept == {i for i, _ in good}
    stay = keep_good(frame)
    assert stay.columns == frame.columns and {r.doc_id for r in stay.collect()} == kept


def test_a_bad_vote_can_be_outweighed(spark):
    """Texts that shout also use bangs and end no sentence; one that only shouts votes like the good ones otherwise."""
    from quarry.llm.quality_rules import assess

    rng = random.Random(3)
    sentences = lambda: " ".join(prose(rng, 12).capitalize() for _ in range(10))
    rows = [(i, sentences()) for i in range(80)] + [(100 + i, prose(rng, 100).upper().replace(" ", "!! ")) for i in range(12)] + [(200, sentences().upper())]
    rows += [(300 + i, " ".join(w + "###" for w in prose(rng, 100).split())) for i in range(30)]
    got = {r.doc_id: r for r in assess(docs_frame(spark, rows)).collect()}
    assert {i for i, r in got.items() if r.kept} == {*range(80), 200}
    assert 0.5 < got[200].quality_probability < min(got[i].quality_probability for i in range(80))


# ---- HTML


def test_html_crf_held_out_and_cases(spark):
    from quarry.llm.html_crf import blocks, extract, labelled, main_text, model, page_features, viterbi

    weights, move = model()
    right = total = 0
    for page, y in labelled(120, 77):
        states = viterbi(page_features(blocks(page)) @ weights, move)
        right += int((states == np.array(y)).sum())
        total += len(y)
    assert right / total > 0.98
    page = "<html><head><title>T</title><style>x{}</style></head><body><nav><ul><li><a href='/a'>Menu item</a></ul></nav><article><h1>A &amp; B</h1><p>First  <b>bold</b>text\nhere, it is long enough. <p>Second &#233;tude, also a sentence.</article><div class='comments'><p>I like it very much.</p></div><footer>&copy; me</footer>"
    assert main_text(page, weights, move) == "A & B First boldtext here, it is long enough. Second étude, also a sentence."
    rows = extract(spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<<<>"), (3, "w", "<<<>")], "page_id long, url string, html string")).collect()
    assert len(rows) == 5 and [r.text for r in rows if r.page_id == 2] == [""] and all(r.n_chars == len(r.text) for r in rows)


def test_html_svg_ends_where_it_ends():
    from quarry.llm.html_crf import blocks

    texts = lambda page: [b[0] for b in blocks(page)]
    assert texts('<p>One <svg class="icon"/>two</p><p>three <math/>four</p>') == ["One two", "three four"]
    assert texts("<p>One <svg><path d='x'/><text>no</text></svg>two</p>") == ["One two"]
    assert texts("<div><p>One <svg><g>no</p><p>two</p></div><p>three</p>") == ["One", "two", "three"]
    assert texts("<p><a>One<canvas>no</a> two</p><div>a<select><option>no<option>no</div><div>b<object>no</div>c") == ["One two", "a", "b", "c"]


# ---- packing


def test_packing_is_gapless_and_as_tight_as_best_fit(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quarry.llm.packing import best_fit, pack, plan

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = pack(docs_frame(spark, texts), path, 256).collect()
    want = []
    for i, t in texts:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, n, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 256))]
    assert sorted(map(str, [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got])) == sorted(map(str, want))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    rng = random.Random(2)
    counts = {}
    for _ in range(3000):
        n = min(256, int(rng.expovariate(1 / 60)) + 1)
        counts[n] = counts.get(n, 0) + 1
    found, bound = plan(counts, 256)
    assert bound - 1e-6 <= sum(found.values()) <= sum(best_fit(counts, 256).values()) + 2
    assert pack(docs_frame(spark, []), path).count() == 0


# ---- top-k


def test_topk_equals_brute_force(spark):
    from quarry.llm.topk import search_shard, top_k

    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 8)).round(2)
    v[50] = v[49]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, [1.0] * 8), (7, [float(x) for x in v[7]]), (504, [])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, shard=128, block=16, chunk=3).collect()
    q = {i: np.floor(256 * np.array(e, float)).astype(int) if e else np.zeros(8, int) for i, e in rows if i is not None and i not in (500, 501, 502, 503)}
    pool = [(i, q[i]) for i in q] + [(7, q[7])]
    want = []
    for i in q:
        if i % 50 == 0:
            best = sorted((-int(q[i] @ e), j) for j, e in pool if j != i)[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    centres = rng.standard_normal((10, 8)) * 50
    m = np.floor(np.repeat(centres, 40, axis=0) + rng.standard_normal((400, 8)))
    _, scored = search_shard(np.array([3]), m[3:4], np.arange(400), np.arange(400), m, 5, 40)
    assert scored < 10  # whole blocks are left out


# ---- quotes


def test_quotes_link_and_order(spark):
    from quarry.llm.quotes import link

    rows = [
        (1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "On Mon X wrote:\n> Hello  there.\n> How are you?\nFine!"), (1, 2, "u", ">> hello there.\n> Fine!\nGood"), (1, 3, "a", "New topic"), (1, 4, "u", "> How are you?\nagain"),
        (1, 5, "x", "> not known\nhm"), (2, 0, "u", None), (None, None, "u", "> Hello there."), (1, 3, "a", "New topic"), (3, 0, "u", "> Hello there."),
    ]
    got = {}
    for r in link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.own_text, r.n_passages, r.n_linked, r.parent_turn, r.root_turn, r.depth, r.position))
    assert got[(1, 1)] == [("Fine!", 1, 1, 0, 0, 1, 1)] and got[(1, 2)] == [("Good", 2, 2, 1, 0, 2, 2)] and got[(1, 4)] == [("again", 1, 1, 0, 0, 1, 3)]
    assert sorted(x[-1] for x in got[(1, 3)]) == [4, 5] and got[(1, 5)] == [("hm", 1, 0, None, 5, 0, 6)]
    assert got[(2, 0)] == [("", 0, 0, None, 0, 0, 0)] and got[(3, 0)][0][3] is None and len(got[(None, None)]) == 1
    assert link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- SimHash


def brute_fingerprint(t):
    import re

    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_fingerprints_and_components(spark, texts):
    from quarry.llm.simhash import keep_one, near_duplicates, signed

    got = near_duplicates(docs_frame(spark, texts)).collect()
    fp = [brute_fingerprint(t) for _, t in texts]
    comp = components_of([(a, b) for a in set(fp) for b in set(fp) if bin(a ^ b).count("1") <= 3], set(fp))
    least = {}
    for (i, _), f in zip(texts, fp):
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    assert sorted(map(str, [(r.doc_id, r.fp, r.component_id) for r in got])) == sorted(map(str, [(i, signed(f), least.get(comp[f])) for (i, _), f in zip(texts, fp)]))
    kept = keep_one(docs_frame(spark, texts)).collect()
    assert len(kept) == len(set(comp.values()))
    assert near_duplicates(docs_frame(spark, [])).count() == 0


def test_covering_masks_and_crowded_buckets(spark):
    from quarry.llm.components import components
    from quarry.llm.shared import Scratch
    from quarry.llm.simhash import links, masks, signed

    rng = random.Random(4)
    tables = masks(3)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(x & m == 0 for m in tables)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(25)})
    want = components_of([(signed(a), signed(b)) for a in fps for b in fps if bin(a ^ b).count("1") <= 3], [signed(f) for f in fps])
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for small in (4096, 5):
        scratch = Scratch(spark, "t")
        found = {r.node: r.root for r in components(scratch, links(scratch, frame, 3, small), "a", "b").collect()}
        assert {n: found.get(n, n) for n in want} == want
        assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in links(scratch, frame, 3, small).collect())


def test_components_of_a_long_chain(spark):
    from quarry.llm.components import components
    from quarry.llm.shared import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "a long, b long")
    found = {r.node: r.root for r in components(Scratch(spark, "t"), edges, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# ---- classifier


def test_classifier_held_out_accuracy(spark):
    from quarry.llm.pu_classifier import classify, keep_good

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.2
        t = prose(rng, rng.randint(20, 120))
        rows.append((i, " ".join(w + "%%%" for w in t.split()) if bad else t))
        if rng.random() < 0.5:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(None, "x"), (900, None), (901, "")]
    frame = docs_frame(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = classify(frame, table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    truth = {i: "%%%" not in (t or "") for i, t in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(truth[r.doc_id] == bool(r.predicted) for r in held) / len(held) > 0.95
    assert keep_good(frame, table).columns == frame.columns
    assert {r.score for r in classify(frame, table.where("false")).collect()} == {0.5}


# ---- SentencePiece


def test_sentencepiece_equals_the_library_and_round_trips(spark, texts):
    import public_tokenizers
    import sentencepiece

    from quarry.llm.piece_codec import PieceCodec, decode_ids, encode_texts

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    odd = ["".join(rng.choice(["a", "aa", " ", "  ", "the", "\n", "é", "é", "梦", "ｱ", "==", "----", "\t", "100", "ing", "...", "😀"]) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    own = PieceCodec(path)
    assert all(np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t) for t in odd)
    got = encode_texts(docs_frame(spark, texts), path)
    assert all(r.round_trip and r.ids == lib.encode(t or "") for r, t in ((r, dict(map(str, x) and x for x in texts).get(r.doc_id)) for r in got.collect()) if r.doc_id is not None)
    back = decode_ids(got, path).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t or "") for i, t in texts}


def test_unigram_scores_are_summed(tmp_path):
    from quarry.llm.piece_codec import PieceCodec, codec  # noqa: F401

    import public_tokenizers

    c = PieceCodec(public_tokenizers.path("piece_bpe_32k.model"), "sum")
    text = "▁another"
    ids = c.chunk(text)
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(1, len(text) + 1):
        for j in range(i):
            n = c.number.get(text[j:i])
            if n is not None:
                best[i] = max(best[i], best[j] + c.score[n])
    assert "".join(c.text[i] for i in ids) == text and sum(c.score[i] for i in ids) == best[-1]


# ---- repeated passages


def brute_repeats(rows, k):
    first, out = {}, []
    order = sorted({(i is None, i if i is not None else 0) for i, _ in rows})
    place = {x: n for n, x in enumerate(order)}
    keyed = [(place[(i is None, i if i is not None else 0)], i, (t or "").encode().split()) for i, t in rows]
    for p, _, w in sorted(keyed, key=lambda x: x[0]):
        for s in range(len(w) - k + 1):
            first.setdefault(tuple(w[s : s + k]), (p, s))
    for p, i, w in keyed:
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (p, s):
                gone[s : s + k] = [True] * k
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def test_repeated_passages(spark, texts):
    from quarry.llm.substring import remove_repeats

    for k in (20, 5):
        got = [tuple(r) for r in remove_repeats(docs_frame(spark, texts), k=k, with_text=False).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute_repeats(texts, k)))
    assert remove_repeats(docs_frame(spark, [])).count() == 0


def test_paths_whose_counts_agree_by_chance(spark):
    from quarry.llm.substring import remove_repeats

    w = [f"w{i}" for i in range(61)]
    rows = [(0, " ".join(w)), (1, " ".join(w[:40])), (2, " ".join(w[21:])), (3, " ".join(w))]
    got = [tuple(r) for r in remove_repeats(docs_frame(spark, rows), with_text=False).collect()]
    assert sorted(got) == sorted(brute_repeats(rows, 20))


# ---- licenses


def test_licenses_against_brute_force(spark, texts):
    import duckdb

    from quarry.llm.licenses import oracle, scan

    rows = [*texts, (40, "Released under the MIT License.\nmore"), (41, "MIT license, mit LICENSE; Apache License"), (42, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files"), (43, "licensed under cc by nc"), (44, "general public licensé"), (45, "mit\tlicense" * 3)]
    got = [tuple(r) for r in scan(docs_frame(spark, rows)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    want = con.execute(oracle()).fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))
    by = {r[0]: r for r in got}
    assert "mit" in by[42][6] and by[43][6] == "" or by[43][6] == "cc-by-nc"
    assert by[23][1] == 0 and by[23][3] is None and scan(docs_frame(spark, [])).count() == 0


def test_short_notices_wrapped_over_lines(spark):
    from quarry.llm.licenses import scan

    unlicense = "This is free and unencumbered software released into the public domain"
    rows = [
        (1, "intro\nLicensed under CC\nBY-NC 4.0\nmore"), (2, unlicense.replace(" ", "\n")), (3, "# Licensed under the\r\n# Apache License,\r\n# Version 2.0"), (4, "Released under the\n MIT License."),
        (5, "Licensed under CC\n\nBY-NC 4.0"), (6, "Licensed by nc\nother words\nunder cc 4.0"), (7, "Licensed under\nCC BY"), (1, "intro\nLicensed under CC\nBY-NC 4.0\nmore"),
    ]
    got = sorted((r.doc_id, r.labels, r.score) for r in scan(docs_frame(spark, rows)).collect())
    assert got == [(1, "cc-by-nc", 1.0), (1, "cc-by-nc", 1.0), (2, "unlicense", 1.0), (3, "apache", 1.0), (4, "mit", 1.0), (5, "", 0.0), (6, "", 0.0), (7, "", 0.0)]


# ---- pipeline


def test_pipeline_stages_compose(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    good = [prose(rng, 140) for _ in range(40)]
    passage = prose(rng, 60)
    rows = [(i, t) for i, t in enumerate(good)] + [(50, good[0]), (51, good[1] + " " + passage), (52, prose(rng, 80) + " " + passage)] + [(60 + i, " ".join(w + "###" for w in prose(rng, 90).split())) for i in range(6)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i >= 60 else 1, 0) for i, _ in rows if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        kept.append(docs)
        assert n == 4 or docs.columns == names
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] == ids[1] == {i for i, _ in rows if i < 60}
    assert ids[2] == ids[1] - {50}
    left = {r.doc_id: r.text for r in kept[3].collect()}
    assert passage not in left[52] and passage in left[51] and ids[3] == ids[2]
    assert ids[4] == ids[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]
