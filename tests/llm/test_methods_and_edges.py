"""The methods themselves against plain versions, and edge cases: empty tables, clashing columns, very wide and very long rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in is it on for was a be as with at".split()


def prose(rng, n, end="."):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choice(["th", "er", "in", "on", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + end


# ---- quality rules


def plain_em(rows, kinds, width, smooth, share, rounds):
    """The mixture of estimate(), document by document, in loops."""
    import math

    total = len(rows)
    belief = []
    for r in rows:
        failed = [k for k in kinds if r[k] == -1]
        belief.append([0.1 if failed else 1.0] + [0.9 / len(failed) if k in failed else 0.0 for k in kinds])
    for _ in range(rounds):
        logs, start = [], []
        for c in range(len(kinds) + 1):
            weight = sum(b[c] for b in belief)
            start.append(math.log((weight + smooth) / (total + smooth * (len(kinds) + 1))))
            rates = []
            for j in range(width):
                held = {v: smooth + (v != -1 and c == 0) * (30 + share * total) / 2 + sum(b[c] for b, r in zip(belief, rows) if r[j] == v) for v in (-1, 0, 1)}
                whole = sum(held.values())
                rates.append({v: math.log(h / whole) for v, h in held.items()})
            if c:
                rates[kinds[c - 1]] = {-1: 0.0, 0: -1e9, 1: -1e9}
            logs.append(rates)
        belief = []
        for r in rows:
            score = [start[c] + sum(logs[c][j][r[j]] for j in range(width)) for c in range(len(kinds) + 1)]
            top = max(score)
            e = [math.exp(s - top) for s in score]
            belief.append([x / sum(e) for x in e])
    return start, logs, belief


def test_estimate_equals_plain_em():
    from quarry.llm.quality_rules import estimate

    rng = random.Random(2)
    rows = [tuple(rng.choice((-1, 0, 0, 1)) if rng.random() < 0.4 else rng.choice((0, 1)) for _ in range(3)) for _ in range(150)]
    counts = sorted({r: rows.count(r) for r in rows}.items())
    kinds = [j for j in range(3) if any(r[j] == -1 for r in rows)]
    for rounds in (1, 7):
        got = estimate(counts, rounds=rounds)
        start, logs, _ = plain_em(rows, kinds, 3, 1.0, 0.25, rounds)
        for c, (odds, weights) in enumerate(got, 1):
            assert odds == pytest.approx(start[c] - start[0])
            for j in range(3):
                for v in (-1, 0, 1):
                    assert weights[j][v] == pytest.approx(logs[c][j][v] - logs[0][j][v])


# ---- HTML: pages by hand, of layouts that the generator does not make. [[ ]] marks the main text.

PAGES = [
    "<html><body><div id='topnav'><a href='/'>Home</a> | <a href='/a'>About</a> | <a href='/c'>Contact us</a></div><div id='main'><h1>[[Repairing a wooden window]]</h1><p>[[Old sash windows can be made to run again, and it takes an afternoon.]]</p><p>[[Start by taking off the beads on the inner side. They are held by small nails.]]</p></div><div id='footer'>© 2019 The joiner's guild. All rights reserved.</div></body></html>",
    "<body><header><a href='/'>The Daily Post</a></header><main><article><h2>[[Council votes for a new bridge]]</h2><p class='byline'>By A. Writer</p><p>[[The council voted on Tuesday to build a bridge across the river.]]</p><blockquote>[[We have waited for thirty years, said the mayor.]]</blockquote><p>[[Work will start in spring, and take two years.]]</p></article><aside class='related'><h3>Related</h3><ul><li><a href='1'>Ferry stops again</a></li><li><a href='2'>Old bridge closed</a></li></ul></aside></main><footer><p>Privacy policy</p><p>Terms of use</p></footer></body>",
    "<body><nav role='navigation'><ul><li><a href='#'>Docs</a><li><a href='#'>Blog</a><li><a href='#'>Pricing</a></ul></nav><section class='post-content'><h1>[[How caches work]]</h1><p>[[A cache keeps what was asked for lately near at hand.]]</p><pre>[[get(key) or load(key)]]</pre><ol><li>[[Look in the cache first, it is fast.]]</li><li>[[Then look in the store, which is slow.]]</li></ol></section><section id='comments'><h3>2 comments</h3><div class='comment'><p>Great text, thanks a lot!</p></div><div class='comment'><p>I do not agree with the second point.</p></div></section></body>",
    "<body><div class='cookie-notice'><p>We use cookies to make this site better.</p><button>Accept all</button></div><div class='content'><h1>[[Soup for cold days]]</h1><p>[[Take two leeks, three potatoes and a spoon of butter.]]</p><p>[[Let it simmer for half an hour, then stir in the cream.]]</p><div class='advert'><p>Buy the best pans today.</p></div><p>[[Serve hot, with bread and a little pepper.]]</p></div><form action='/s'><label>Search recipes</label><input name='q'><button>Go</button></form></body>",
    "<body><header class='site-header'><div class='logo'>Mountain Club</div><nav><a href='/t'>Tours</a><a href='/h'>Huts</a></nav></header><article class='entry'><h1>[[Across the glacier in two days]]</h1><p>[[We left the hut at four in the morning, under a clear sky.]]</p><h3>[[The ascent]]</h3><p>[[The snow was hard, and the rope teams moved well.]]</p><table><tr><td>[[Height gained: 1,240 metres in all, by the map.]]</td></tr></table></article><div class='sidebar'><h4>Newsletter</h4><form><label>Your address</label><button>Subscribe</button></form></div><footer>Imprint · Contact</footer></body>",
    "<body><main><h1>[[Learning to read late]]</h1><p>[[She was forty when she read her first book, a thin one about birds.]]</p><p>[[It took her a winter.]]</p><p>[[Today she teaches others, twice a week, in the library by the station.]]</p></main><div class='share-buttons'><a href='#'>Share</a><a href='#'>Tweet</a></div><div class='comments-area'><h2>Leave a reply</h2><p>Your email address will not be published.</p></div></body>",
    "<body><div class='wrapper'><div class='menu'><ul><li><a href='1'>News</a></li><li><a href='2'>Sport</a></li><li><a href='3'>Culture</a></li></ul></div><div class='story'><h1>[[Home side wins in the last minute]]</h1><p>[[A late header gave the home side three points on Saturday.]]</p><p>[[The visitors had led since the tenth minute, &amp; looked safe.]]</p></div><div class='promo'><p>Win two tickets for the next match!</p></div></div></body>",
    "<body><article><h1>[[Why rivers bend]]</h1><p>[[A river that runs straight does not stay so for long.]]<p>[[The outer bank is worn away, the inner one grows.]]<ul><li>[[Slow water drops its sand.]]<li>[[Fast water takes it along.]]</ul></article><aside><p>Sponsored: boats for hire</p></aside><footer><ul><li><a href='#'>About</a></li><li><a href='#'>Jobs</a></li></ul></footer></body>",
]


def test_html_on_pages_labelled_by_hand():
    from quarry.llm.html_crf import blocks, model, page_features, viterbi

    weights, move = model()
    right = total = 0
    for marked in PAGES:
        found = blocks(marked)
        truth = np.array(["[[" in b[0] for b in found], int)
        plain = blocks(re.sub(r"\[\[|\]\]", "", marked))
        assert len(plain) == len(found)
        states = viterbi(page_features(plain) @ weights, move)
        right += int((states == truth).sum())
        total += len(truth)
    print(f"blocks labelled by hand: {right} of {total} right")
    assert right / total >= 0.93


def test_viterbi_and_gradient_of_the_crf():
    from itertools import product

    from quarry.llm.html_crf import NAMES, train, viterbi

    rng = np.random.default_rng(1)
    for n in range(1, 7):
        score, move = rng.standard_normal(n), rng.standard_normal((2, 2))
        value = lambda y: sum(score[i] * y[i] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        assert value(viterbi(score, move).tolist()) == pytest.approx(max(value(y) for y in product((0, 1), repeat=n)))
    assert len(viterbi(np.zeros(0), np.zeros((2, 2)))) == 0
    pages = [(rng.integers(0, 2, (n, len(NAMES))).astype(float), rng.integers(0, 2, n)) for n in (3, 5, 2)]

    def likelihood(w, move):
        out = 0.0
        for x, y in pages:
            s = x @ w
            value = lambda y: sum(s[i] * y[i] for i in range(len(s))) + sum(move[y[i], y[i + 1]] for i in range(len(s) - 1))  # noqa: B023, E731
            out += value(y) - np.log(sum(np.exp(value(z)) for z in product((0, 1), repeat=len(s))))
        return out / len(pages) - 0.5e-3 * ((w**2).sum() + (move**2).sum())

    before = likelihood(np.zeros(len(NAMES)), np.zeros((2, 2)))
    few, many = likelihood(*train(pages, steps=5)), likelihood(*train(pages, steps=400))
    w, move = train(pages, steps=400)
    assert before < few < many
    for _ in range(20):  # no better point nearby
        assert likelihood(w + 0.03 * rng.standard_normal(len(w)), move + 0.03 * rng.standard_normal((2, 2))) <= many + 1e-4


def test_html_edges(spark):
    from quarry.llm.html_crf import blocks, extract

    texts = lambda page: [b[0] for b in blocks(page)]
    assert texts("<p>A</p><iframe src=x/><p>B</p>") == ["A", "B"] and texts("<p>A</p><textarea><p>B</p>") == ["A", "B"]
    assert texts("<p>A</p><script>x('</p>'); <p>B</p>") == ["A"] and texts("<p hidden>A</p><p style='display: none'>B</p>") == ["A", "B"]
    schema = "page_id long, url string, html string, text string, n_chars string"
    assert extract(spark.createDataFrame([], schema)).count() == 0
    long = "<article>" + "<p>A sentence that goes on for a while, with commas, and ends here.</p>" * 20_000 + "</article>"
    rows = extract(spark.createDataFrame([(1, "u", long, "x", "y"), (1, "u", long, "x", "y")], schema)).collect()
    assert len(rows) == 2 and all(r.n_chars == len(r.text) > 1_000_000 for r in rows)


# ---- packing


def test_most_sequences_come_from_the_program():
    from quarry.llm.packing import best_fit, plan, solve

    rng = random.Random(4)
    for mean, capacity in ((60, 256), (150, 256), (400, 2048)):
        counts: dict = {}
        for _ in range(1500):
            n = min(capacity, int(rng.expovariate(1 / mean)) + 1)
            counts[n] = counts.get(n, 0) + 1
        found, bound = plan(counts, capacity)
        used: dict = {}
        for pattern, n in found.items():
            assert sum(k * a for k, a in pattern) <= capacity
            for k, a in pattern:
                used[k] = used.get(k, 0) + a * n
        assert used == counts and sum(found.values()) >= bound - 1e-6
        assert sum(found.values()) <= sum(best_fit(counts, capacity).values()) + 1 and sum(found.values()) <= bound + 3
    assert plan({}, 8) == ({}, 0.0)
    shares, bound = solve({5: 4, 3: 4}, 8, 50)
    assert bound == pytest.approx(4, abs=0.2) and all(sum(k * a for k, a in p) <= 8 for p in shares)


def test_tails_are_parted_as_by_a_regular_expression():
    from quarry.llm.word_tokens import part_tails

    rng = random.Random(6)
    tail = re.compile(rb"([0-9A-Za-z])([!-/:-@\[-`{-~]+)(?=[\x20\x09-\x0D]|\Z)")
    for _ in range(2000):
        raw = "".join(rng.choice(["a", "Z", "7", ".", "!", "'", " ", "\n", "é", "»", "\x1c", "_"]) for _ in range(rng.randint(0, 12))).encode()
        assert part_tails(raw) == tail.sub(rb"\1 \2", raw)


# ---- top-k


def test_topk_edges(spark):
    from quarry.llm.topk import top_k

    schema = "vec_id long, embedding array<double>, row string, id string, v int, shard int"
    assert top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16)) * 8
    rows = [(i, [float(x) for x in centres[i % 12] + rng.standard_normal(16) * 0.1], "x", "y", 1, 2) for i in range(600)] + [(1000, [1.0] * 50_000, "x", "y", 1, 2), (1001, [0.5], "x", "y", 1, 2)]
    frame = spark.createDataFrame(rows, schema)
    e = {i: np.floor(256 * np.array(v)).astype(int) for i, v, *_ in rows}
    dot = lambda a, b: int(a[: len(b)] @ b[: len(a)])
    want = [(q, n, j, -s) for q in e if q % 50 == 0 for n, (s, j) in enumerate(sorted((-dot(e[q], e[j]), j) for j in e if j != q)[:5], 1)]
    for sent in (1 << 25, 0):
        got = top_k(frame, F.col("vec_id") % 50 == 0, shard=64, block=8, chunk=4, sent=sent).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_queries_start_from_what_they_found_at_home():
    from quarry.llm.topk import search_shard

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((10, 8)) * 50
    m = np.floor(np.repeat(centres, 40, axis=0) + rng.standard_normal((400, 8)))
    home, _ = search_shard(np.array([3]), m[3:4], np.arange(40), np.arange(40), m[:40], 5, 8)
    floor = np.array([home[0][1][-1]], float)
    away, scored = search_shard(np.array([3]), m[3:4], np.arange(40, 400), np.arange(40, 400), m[40:], 5, 8, floor)
    exact = m[40:] @ m[3]
    assert set(away[0][0].tolist()) >= set((np.flatnonzero(exact > floor[0]) + 40).tolist()[:5]) and scored <= 45
    assert scored < search_shard(np.array([3]), m[3:4], np.arange(40, 400), np.arange(40, 400), m[40:], 5, 8)[1] or scored == 0


# ---- quotes


def plain_links(rows):
    """(parent turn, linked passages) of every message, in loops."""
    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip(" ")

    def parse(text):
        out = []
        for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            m = re.match(r"[ \t]*(>[> \t]*)", line)
            out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
        return out

    def units(bodies, least):
        whole = norm(" ".join(bodies))
        out = [(0, whole)] + [(p, t) for p, t in [(1, norm(b)) for b in bodies] + [(2, s) for s in re.split(r"(?<=[.!?]) ", whole)] if len(t.split(" ")) >= least]
        return [(p, t) for p, t in out if t]

    parsed = []
    for conv, turn, text in rows:
        lines = parse(text)
        passages, before = [], 0
        for level, body in lines:
            if level and level == before:
                passages[-1][1].append(body)
            elif level:
                passages.append((level, [body]))
            before = level
        parsed.append((conv, turn, [b for level, b in lines if level == 0], passages))
    out = []
    for conv, turn, _, passages in parsed:
        found, best = set(), None
        for at, (level, bodies) in enumerate(passages):
            for n, (part, t) in enumerate(units(bodies, 3)):
                origins = [t2 for c2, t2, own, _ in parsed if c2 == conv and t in [u for _, u in units(own, 0)]]
                if origins and min(origins) < turn:
                    found.add(at)
                    key = (level, part, at, n, min(origins))
                    best = key if best is None else min(best, key)
        out.append((conv, turn, best[-1] if best else None, len(passages), len(found)))
    return out


def test_quotes_against_plain_version(spark):
    from quarry.llm.quotes import link

    rng = random.Random(12)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(8):
            own = [prose(rng, rng.randint(1, 9)).capitalize() for _ in range(rng.randint(1, 3))]
            quote = []
            if said and rng.random() < 0.7:
                source = rng.choice(said)
                kind = rng.randint(0, 3)
                lines = source if kind == 0 else [rng.choice(source)] if kind == 1 else " ".join(source).replace(" ", "\n", 2).split("\n") if kind == 2 else [prose(rng, 5)]
                quote = [">" * rng.randint(1, 2) + " " * rng.randint(0, 1) + x for x in lines]
            text = "\n".join(quote + own)
            said.append(own)
            rows.append((conv, turn, text))
    frame = spark.createDataFrame([(c, t, "u", x, "clash", 7) for c, t, x in rows], "conv_id long, turn long, role string, text string, own_text string, depth int")
    got = link(frame).select("conv_id", "turn", "parent_turn", "n_passages", "n_linked").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_links(rows)))
    assert any(r.n_linked for r in got) and any(r.n_passages > r.n_linked for r in got)


def test_a_very_long_quotation(spark):
    from quarry.llm.quotes import link

    lines = [f"line number {i} of a long mail" for i in range(30_000)]
    rows = [(1, 0, "u", "\n".join(lines)), (1, 1, "u", "\n".join("> " + x for x in lines) + "\nyes")]
    got = {r.turn: r for r in link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].parent_turn == 0 and got[1].n_passages == 1 and got[1].own_text == "yes"


# ---- classifier


def test_risk_and_its_gradient():
    from quarry.llm.pu_classifier import SIZE, losses, risk

    rng = np.random.default_rng(2)
    p, u = rng.standard_normal((40, SIZE)), rng.standard_normal((60, SIZE))
    for prior, w in ((0.5, rng.standard_normal(SIZE) * 0.01), (0.3, np.zeros(SIZE)), (0.9, (p.mean(axis=0) - u.mean(axis=0)) * 3)):
        value, negative, step = risk(p, losses(u, w), prior, w)
        soft = lambda z: np.logaddexp(0, z).mean()
        assert negative == pytest.approx(soft(u @ w) - prior * soft(p @ w)) and value == pytest.approx(prior * soft(-(p @ w)) + max(0, negative))
        whole = lambda w: -(soft(u @ w) - prior * soft(p @ w)) if negative < 0 else prior * soft(-(p @ w)) + soft(u @ w) - prior * soft(p @ w)  # noqa: B023, E731
        for j in rng.integers(0, SIZE, 12):
            d = np.zeros(SIZE)
            d[j] = 1e-5
            assert step[j] == pytest.approx((whole(w + d) - whole(w - d)) / 2e-5, abs=1e-6)


def test_fit_uses_all_rows_and_stays_non_negative(spark):
    from quarry.llm.pu_classifier import SIZE, class_prior, fit, losses, risk

    rng = np.random.default_rng(4)
    n, share = 1200, 0.7
    good = rng.random(n) < share
    u = (rng.standard_normal((n, SIZE)) * 0.03).astype(np.float16)
    u[:, 0] = 1
    u[~good, 1] += 3
    p = (rng.standard_normal((500, SIZE)) * 0.03).astype(np.float16).astype(float)
    p[:, 0] = 1
    frame = spark.createDataFrame([(bytearray(x.tobytes()), i % 2 == 0) for i, x in enumerate(u)], "x binary, even boolean").repartition(5)
    scale = np.ones(SIZE, np.float32)
    prior = class_prior(p, frame, scale)
    assert abs(prior - share) < 0.15
    w = fit(p, frame, scale, prior, first=u[:300].astype(float))
    z = u.astype(float) @ w
    assert ((z > 0) == good).mean() > 0.97
    assert risk(p, losses(u.astype(np.float32), w), prior, w)[1] > -0.03


# ---- repeated passages


def test_repeats_under_hash_collisions_and_long_places(spark):
    from test_training_data import brute_repeats
    from quarry.llm.substring import remove_repeats

    rng = random.Random(21)
    passages = [prose(rng, 40, "") for _ in range(4)]
    rows = [(i, " ".join(rng.choice([*passages, prose(rng, 25, ""), prose(rng, 9, "")]) for _ in range(rng.randint(1, 4)))) for i in range(40)]
    rows += [(50, passages[0] + " x " + passages[0]), (51, None), (52, ""), (None, passages[1]), (7, rows[7][1])]
    frame = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, n_words string, kept_sha256 string")
    want = sorted(map(str, brute_repeats(rows, 20)))
    for hash_bits, bits in ((64, 3), (6, 24), (2, 5)):
        got = [tuple(r) for r in remove_repeats(frame, with_text=False, hash_bits=hash_bits, bits=bits).collect()]
        assert sorted(map(str, got)) == want


# ---- SentencePiece


def test_one_piece_is_admissible_at_every_position():
    """In merge mode the best score is that of the one candidate that passes, whatever the order of relaxation."""
    import public_tokenizers
    import sentencepiece

    from quarry.llm.piece_codec import CHUNK, MARK, PieceCodec

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, lib, rng = PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(31)
    a = own.automaton
    for _ in range(150):
        text = MARK + "".join(rng.choice(["th", "e", "in", "ing", "a", "aa", "==", "-", "é", "100", "梦", MARK]) for _ in range(rng.randint(1, 14)))
        for chunk in CHUNK.findall(text):
            state, last = 0, [-1]
            for i, ch in enumerate(chunk, 1):
                while state and ch not in a.child[state]:
                    state = a.fail[state]
                state = a.child[state].get(ch, 0)
                passing = [number for number, size in a.link_outputs(state) if own._may_follow(last[i - size], number)]
                assert len(passing) <= 1
                last.append(passing[0] if passing else -1)
        plain = text[1:].replace(MARK, " ")
        assert np.frombuffer(own.encode(plain), "<u4").tolist() == lib.encode(plain)


def test_encode_edges(spark):
    import public_tokenizers

    from quarry.llm.piece_codec import decode_ids, encode_texts

    path = public_tokenizers.path("piece_bpe_32k.model")
    schema = "doc_id long, text string, n_ids string, ids string"
    assert encode_texts(spark.createDataFrame([], schema), path).count() == 0
    got = encode_texts(spark.createDataFrame([(1, "a" * 200_000, "x", "y"), (1, None, "x", "y"), (2, "", "x", "y")], schema), path).collect()
    assert sorted((r.doc_id, r.n_ids > 0, r.round_trip) for r in got) == [(1, False, True), (1, True, True), (2, False, True)]
    assert decode_ids(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<long>"), path).orderBy("doc_id").collect()[1].text == ""


# ---- shared joins


def test_join_spread_keeps_all_rows(spark):
    from quarry.llm.shared import Scratch, join_spread

    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 1), (None, 9)], "k int, x int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k int, y string")
    want = sorted(map(tuple, left.join(right, ["k"]).collect()))
    for least in (10, 1000):
        assert sorted(map(tuple, join_spread(Scratch(spark, "t"), left, right, ["k"], least).collect())) == want


def test_common_windows_meet_by_broadcast(spark, monkeypatch):
    from test_training_data import brute_repeats
    from quarry.llm import substring

    monkeypatch.setattr(substring, "COMMON", 5)
    rng = random.Random(22)
    passage = prose(rng, 45, "")
    rows = [(i, prose(rng, 30, "") + " " + passage + " " + prose(rng, 25, "")) for i in range(20)] + [(30, passage), (31, prose(rng, 60, "")), (32, prose(rng, 60, ""))]
    rows.append((33, rows[-1][1]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in substring.remove_repeats(frame, with_text=False).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_repeats(rows, 20)))


# ---- pipeline


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns go through every stage; so does an empty table."""
    import corpus_pipeline

    rng = random.Random(33)
    texts = [prose(rng, 120) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (20, texts[2]), (None, texts[4]), (21, None), (22, ""), (23, "one")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, n_words int, score double, __fp string, d0 int"
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 0.5, "y", 2) for i, t in rows], schema)
    spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for n, docs in (("some", frame), ("none", frame.where("false"))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, str(tmp_path))
            made.write.parquet(f"{tmp_path}/{n}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{n}{k}")
            assert k == 4 or docs.columns == frame.columns
        left = spark.read.parquet(f"{tmp_path}/{n}3")
        assert left.count() == (8 if n == "some" else 0) and docs.count() >= left.count()
        assert {r.doc_id for r in left.collect()} == (set(range(8)) if n == "some" else set())
