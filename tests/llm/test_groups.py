"""Pair, conversation, page and language operators, and the pipeline, against brute force."""

import random
import re

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from tracewright.llm import chat, common, html_mincut, lang_cnn, lattice_dedup, lsh_forest


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def reach(ids, links):
    low = {i: i for i in ids}
    while True:
        was = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == was:
            return low


def test_components_by_search(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(500 + k, 501 + k) for k in range(40)] + [(7, 7)]
    got = dict(map(tuple, common.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    real = [p for p in links if p[0] != p[1]]
    assert got == reach({x for p in real for x in p}, real)
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        n = min(5, len(w))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return out


def jaccard_by_brute_force(docs):
    s = sets([t for _, t in docs])
    links, n = [], [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and None not in (docs[i][0], docs[j][0]) and both >= 0.8 * (len(s[i]) + len(s[j]) - both) - 1e-9:
                n[i] += 1
                n[j] += 1
                links.append((docs[i][0], docs[j][0]))
    low = reach({i for i, _ in docs}, links)
    return by_id((i, k, low[i]) for (i, _), k in zip(docs, n))


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    docs = []
    for _ in range(12):
        words = prose(rng, 150).split()
        for _ in range(rng.randint(1, 8)):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 12])):
                w[rng.randrange(len(w))] = "changed"
            docs.append((len(docs), " ".join(w)))
    return docs


@pytest.mark.parametrize("block", [lsh_forest.BLOCK_SHINGLES, 400])
def test_jaccard_join(spark, copies, odd_docs, block, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK_SHINGLES", block)
    docs = copies + [(1000 + r.doc_id if r.doc_id is not None else None, r.text) for r in odd_docs.collect()]
    got = lsh_forest.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert by_id((r.doc_id, r.n_links, r.component_id) for r in got) == jaccard_by_brute_force(docs)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_forest_prefix_and_empty_table(no_docs, odd_docs):
    d = lsh_forest.shortest(0.8, 24, 8, 0.9995)
    assert 1 - (1 - 0.8**d) ** 24 >= 0.9995 > 1 - (1 - 0.8 ** (d + 1)) ** 24
    assert lsh_forest.jaccard_join(no_docs).count() == 0
    kept = lsh_forest.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 7, 8, None, 9, 10, 12}


def near_texts(n, share, seed=3):
    """Pairs of texts of 200 words whose sets of shingles have about that similarity."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        cut = round(200 * (1 - share) / (1 + share))  # a run of new words at the end changes as many shingles
        out += [" ".join(a), " ".join(a[: len(a) - cut] + [f"v{rng.randrange(10**6)}" for _ in range(cut)])]
    return out


def test_forest_shortens_prefixes_until_the_recall_is_met(spark):
    def reached(share, n):
        texts = near_texts(n, share)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        every = lsh_forest.profiles(docs, 24, 8)
        classes = common.stored(every.select(F.col("doc_id").alias("cid"), F.col("doc_id").alias("id"), "text_key", "fp1", "fp2", F.lit(1).cast("long").alias("copies"), "n_marks", "signature"), "t")
        links, prefix = lsh_forest.all_links(docs, classes, 0.8, 24, 8, 0.9995)
        return prefix, links.count() / (2 * n)

    assert reached(0.97, 150) == (8, 1.0)  # full paths find them all
    prefix, recall = reached(0.81, 150)
    assert prefix in (5, 6) and recall >= 0.99
    assert lsh_forest.estimated_recall(np.zeros(40), 0.8, 24, 8) == 0.0


def test_similarity_of_signatures():
    rng = np.random.default_rng(2)
    marks = np.unique(lsh_forest.mix(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)))
    a, b = (np.frombuffer(lsh_forest.signature(m, 24, 8), "<u2") for m in (marks[:900], marks[100:]))
    assert abs((a == b).mean() - 0.8) < 0.1


def vectors(seed=1, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(30):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(1, 9))):
            noise = rng.normal(size=dim)
            noise -= noise @ centre * centre
            c = rng.uniform(0.93, 0.999)
            rows.append((len(rows), (rng.uniform(0.1, 9) * (c * centre + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise))).tolist()))
    return rows


@pytest.mark.parametrize("block", [lattice_dedup.BLOCK, 3])
def test_lattice_links(spark, block, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "BLOCK", block)
    rows = vectors()
    rows += [(900, rows[0][1]), (901, rows[0][1]), (901, rows[0][1]), (902, None), (903, [0.0] * 64), (904, [float("nan")] * 64), (905, [1.0] * 63 + [None]), (906, [1.0]), (907, []), (908, [float("inf")] * 64), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id string")
    got = lattice_dedup.near_duplicates(df).collect()
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(v)]
    n, links = {i: 0 for i, _ in rows}, []
    for k, (i, v) in enumerate(good):
        for j, w in good[:k]:
            if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                links.append((i, j))
                n[i] += 1
                n[j] += i != j
    n[901] = n[900]  # repeated rows of one id: each links with the other
    low = reach([i for i, _ in rows], links)
    assert by_id((r.vec_id, r.n_links, r.component_id) for r in got) == by_id((i, n[i], low[i]) for i, _ in rows)
    assert lattice_dedup.near_duplicates(df.limit(0)).count() == 0


def test_one_id_with_two_vectors(spark):
    turn = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0]
    rows = [(1, turn(0.0)), (1, turn(2.0)), (2, turn(0.1)), (3, turn(2.1)), (4, turn(2.12)), (5, [0.0, -0.0, 1.0]), (6, [-0.0, 0.0, 1.0])]
    got = lattice_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert by_id((r.vec_id, r.n_links, r.component_id) for r in got) == by_id([(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (5, 1, 5), (6, 1, 5)])


def near_pairs(dim, n):
    rng = np.random.default_rng(dim)
    a, z = rng.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    return a, 0.9501 * a + np.sqrt(1 - 0.9501**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


@pytest.mark.parametrize("dim", [2, 4, 8, 16, 24, 32, 48, 64, 100, 384])
def test_recall_at_every_dimension(dim):
    a, b = near_pairs(dim, 2000)
    p, q = (lattice_dedup.Lattice(dim).cells(x) for x in (a, b))
    met = ((p[:, :, :1] == q).any(axis=2) | (q[:, :, :1] == p).any(axis=2)).any(axis=1)
    assert (~met).sum() <= 1


def test_vectors_of_several_lengths(spark):
    vectors_ = [v.tolist() for dim, n in ((8, 40), (16, 30), (24, 20)) for x in near_pairs(dim, n) for v in x] + [[1.0], [2.0]]
    rows = [*enumerate(vectors_), (500, vectors_[-5]), (501, vectors_[-5]), (502, [0.0] * 16)]
    got = lattice_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if np.any(v)}
    links = [(i, j) for i, v in unit.items() for j, w in unit.items() if i < j and len(v) == len(w) and v @ w >= 0.95]
    assert {len(unit[i]) for i, _ in links} == {1, 8, 16, 24}
    low = reach([i for i, _ in rows], links)
    assert by_id((r.vec_id, r.n_links, r.component_id) for r in got) == by_id((i, sum(i in e for e in links), low[i]) for i, _ in rows)


def test_nearest_lattice_point_by_search():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(200, 8)) * 3
    got, steps = lattice_dedup.nearest_e8(y), lattice_dedup.minimal_vectors()
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    for p, q in zip(y, got):  # no neighbouring point is nearer, and the point is of the lattice
        assert ((p - q) ** 2).sum() <= ((p - q - steps) ** 2).sum(axis=1).min() + 1e-9
        assert np.allclose(q * 2, np.rint(q * 2)) and np.allclose((q - q[0]) % 1, 0) and q.sum() % 2 == 0


def test_chat(spark):
    say = lambda c, *turns: [(c, k, "user" if k % 2 == 0 else "assistant", t, 0) for k, t in enumerate(turns)]
    rows = say(1, "a", "b") + say(2, "a", "b", "c", "d") + say(3, "a", "x") + say(4, "a", "b", "c", "d") + say(5, "a") + [(None, 0, "user", "z", 0), (6, None, None, None, 0), (6, 1, "user", "q", 0), (6, 1, "user", "q", 0)]
    rows += [(7, k, "user", f"t{k}", 0) for k in range(700)] + [(8, k, "user", f"t{k}", 0) for k in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int")
    got = {r.conv_id: r for r in chat.collapse_and_render(df).collect()}
    assert {k: (r.n_turns, r.n_equal) for k, r in got.items()} == {2: (4, 2), 3: (2, 1), 6: (2, 1), 7: (700, 1)}
    assert got[3].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert got[6].rendered == "<|im_start|>\n<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    assert chat.collapse_and_render(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header>
<nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept them now please.</div><main><article><h1>Title</h1><p><b>First &amp; best.<br><p>Second   part
goes on.</p><div class="ad">Buy this now. It is good.</div><p>To.</p><form>Name <button>Send</button></form><section id="comments"><p>Nice article, I liked it a lot, thanks.</p></section></article></main>
<aside><p>Sidebar text that is long. Really long sentence here.</p></aside><footer>&copy; 2020</footer></body></html>"""


def test_pages(spark):
    plain = "<div id=menu><a>a</a> <a>b</a></div><div><h2>A title</h2><p>This is a long paragraph of plain text without any container, it goes on and on for a while.</p>Loose text in it. <p>Ok</p></div><div><a href=x>one</a> | <a href=y>two</a></div>"
    rows = [(1, "u", PAGE), (2, "u", plain), (3, None, None), (4, "u", ""), (5, "u", "<p>cut off <b>here. And &am"), (6, "u", "<nav>only a menu</nav>"), (None, "u", "<" * 50), (7, "u", "<div>" * 3000 + "deep"), (1, "u", PAGE)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_mincut.extract(df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 9 and all(r.n_chars == len(r.text) for r in got)
    assert text[1] == "Title\n\nFirst & best.\n\nSecond part goes on.\n\nTo."
    assert text[2].split("\n\n")[0] == "A title" and "Loose text" in text[2] and "one" not in text[2]
    assert text[3] == text[4] == text[6] == "" and text[5] == "cut off here. And &am"
    assert html_mincut.extract(df.limit(0)).count() == 0


LONG = "The quick brown fox jumps over the lazy dog while many other animals look on from the edge of the wood. "


@pytest.mark.parametrize("wrapper", ["<div class='layout has-sidebar'>", "<div id='page' class='no-comments'>", "<section class='legal-content'>", "<div class='sidebar-left layout'>", "<form id=aspnet>"])
@pytest.mark.parametrize("inner", ["<article>", "<div>"])
def test_names_of_wrappers(wrapper, inner):
    prose_ = [f"{k}. {LONG}{LONG}".strip() for k in range(4)]
    page = f"<body><nav><a href=/>Home</a></nav>{wrapper}{inner}{''.join(f'<p>{p}</p>' for p in prose_)}</div></article></section></form></div><div class='cookie-notice'>We use cookies. Accept them now.</div></body>"
    assert html_mincut.main_text(page) == "\n\n".join(prose_)


def test_names_are_weighed():
    ps = [f"{k}. {LONG}{LONG}".strip() for k in range(6)]
    page = "<body>" + "".join(f"<p>{p}</p>" for p in ps[:3]) + f"<div class='legal'><p>{ps[3]}</p></div><p>{ps[4]}</p><div class=sidebar><p>Short note here.</p></div><p>{ps[5]}</p></body>"
    assert html_mincut.main_text(page) == "\n\n".join(ps)
    cards = "".join(f"<article><h3>Read more of it {k}</h3></article>" for k in range(5))
    page = f"<body><article><p>{ps[0]}</p><p>{ps[1]}</p></article><div class=related>{cards}</div></body>"
    assert html_mincut.main_text(page) == "\n\n".join(ps[:2])


def test_end_tags_of_deep_elements():
    deep = "<div>" * 600 + "<p>deep words</p>" + "</div>" * 600
    first, second = f"<div><article><p>{LONG}</p>{deep}<p>{LONG}</p></article></div>", f"<aside><p>{LONG}</p></aside>"
    blocks = html_mincut.blocks_of(f"<body>{first}{second}</body>")
    assert [(len(b.path), b.good, b.bad) for b in blocks] == [(4, True, False), (512, True, False), (4, True, False), (3, False, True)]


@pytest.mark.parametrize("seed", range(25))
def test_cut_is_the_cheapest(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    a, b = ([rng.randint(0, 20) for _ in range(n)] for _ in range(2))
    ties = [(i, j, rng.randint(0, 9)) for i in range(n) for j in range(i) if rng.random() < 0.4]
    cost = lambda side: sum(b[k] if s else a[k] for k, s in enumerate(side)) + sum(c for i, j, c in ties if side[i] != side[j])
    best = min(cost([m >> k & 1 for k in range(n)]) for m in range(1 << n))
    assert cost(html_mincut.source_side(a, b, ties)) == best


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    tongues = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "ung", "ver", "ich"], "cc": ["é", "eau", "que", "oi"]}
    rows = []
    for k in range(240):
        lang = rng.choice(sorted(tongues))
        rows.append((k, " ".join("".join(rng.choices(tongues[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 120))), lang, "s", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_language_id(spark, labelled, odd_docs, no_docs):
    got = lang_cnn.identify(labelled).join(labelled.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)
    net = lang_cnn.learn(labelled)
    odd = {r.doc_id: r for r in lang_cnn.predict(odd_docs.drop("score"), net).collect()}
    assert odd[4].lang_pred == odd[5].lang_pred == odd[6].lang_pred == "und" and odd[7].lang_pred in net.languages
    assert lang_cnn.identify(no_docs).count() == 0
    assert lang_cnn.keep_known(labelled).columns == labelled.columns


def test_windows_by_plain_convolution():
    rng = np.random.default_rng(3)
    net = lang_cnn.train([("a", "abc abc"), ("b", "xyz xyz")])
    x = rng.integers(0, 256, (3, lang_cnn.WINDOW)).astype(np.uint8)
    want = [[max(sum(t[o][x[i, p + o], f] for o in range(len(t))) for p in range(lang_cnn.WINDOW - len(t) + 1)) for t in net.tables for f in range(lang_cnn.FILTERS)] for i in range(3)]
    assert np.allclose(net.features(x), np.maximum(np.array(want) + net.bias, 0), atol=1e-4)


def test_pipeline_stages(spark, labelled):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    one = labelled.where("doc_id = 0")
    copy = one.withColumn("doc_id", F.lit(5000).cast("long"))
    junk = one.withColumn("doc_id", F.lit(5001).cast("long")).withColumn("text", F.lit("12 34 !!"))
    secret = one.withColumn("doc_id", F.lit(5002).cast("long")).withColumn("text", F.lit("ka ro mitu password = hunter2222 karo tumi ro kami rotu"))
    docs = labelled.unionByName(copy).unionByName(junk).unionByName(secret)
    a = c.STAGES[0][1](spark, docs, "")
    assert a.columns == docs.columns and {5001} == {r.doc_id for r in docs.join(a, "doc_id", "left_anti").collect()}
    b = c.STAGES[1][1](spark, a, "")
    gone = {r.doc_id for r in a.join(b, "doc_id", "left_anti").collect()}
    assert 5000 in gone and b.columns == docs.columns
    s = c.STAGES[2][1](spark, b, "")
    assert s.count() == b.count() and "hunter" not in s.where("doc_id = 5002").first().text and s.columns == docs.columns
    p = c.STAGES[3][1](spark, s, "")
    assert {r.doc_id for r in p.collect()} == {r.doc_id for r in s.collect()}


def unmarked_pages(n, seed=7):
    """(page that marks its article, the same page in plain divs, the article's blocks); one block alone tells little."""
    rng = random.Random(seed)
    for _ in range(n):
        say = lambda least, most: prose(rng, rng.randint(least, most))
        ps = [say(15, 60) + "." if rng.random() < 0.7 else say(1, 6) for _ in range(rng.randint(5, 12))]
        note = [say(15, 30) + "." if rng.random() < 0.1 else say(1, 6) for _ in range(rng.randint(4, 9))]
        body, side = ("".join(f"<div>{t}</div>" for t in x) for x in (ps, note))
        yield f"<body><div>{side}</div><article>{body}</article></body>", f"<body><div>{side}</div><div>{body}</div></body>", ps


def test_the_cut_changes_blocks_of_pages_without_marks(spark):
    pages = list(unmarked_pages(160))
    weights = html_mincut.fitted([a for a, _, _ in pages[:80]])
    mended = broken = total = wrong = 0
    for _, page, want in pages[80:]:
        blocks = html_mincut.blocks_of(page)
        for cut, score, b in zip(html_mincut.content(blocks, weights), html_mincut.scores(blocks, weights), blocks):
            truth, sign = b.text in want, score > 0
            total += 1
            wrong += cut != truth
            mended += cut == truth != sign
            broken += sign == truth != cut
    assert mended > 2 * broken and mended + broken > 0.02 * total and wrong < 0.05 * total, (mended, broken, wrong, total)
    df = spark.createDataFrame([(k, f"u{k}", a) for k, (a, _, _) in enumerate(pages)], "page_id long, url string, html string")
    assert np.allclose(html_mincut.learn(df, most=160), html_mincut.fitted([a for a, _, _ in pages]))
    assert (html_mincut.learn(df.limit(0)) == html_mincut.BY_HAND).all()


def test_predictions_replace_columns_of_their_names(spark, odd_docs):
    net = lang_cnn.train([("en", "the cat and the dog " * 20), ("fr", "le chat et le chien " * 20)] * 4)
    df = spark.createDataFrame([(1, "le chat et le chien " * 5, 5, "x", "y"), (2, "½ ² ① Ⅷ", 5, "x", "y"), (3, None, 5, "x", "y")], "doc_id long, text string, score int, _pred string, Lang_Pred string")
    got = lang_cnn.predict(df, net)
    assert got.columns == ["doc_id", "text", "_pred", "lang_pred", "score"]
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "fr", 2: "und", 3: "und"}
    df = df.withColumn("lang", F.lit("fr"))
    assert lang_cnn.keep_known(df).columns == df.columns and lang_cnn.keep_known(df).count() <= 3


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_stages_on_odd_tables(spark, odd_docs, no_docs, empty):
    import corpus_pipeline

    clash = ["score", "_row", "cid", "id", "text_key", "_spans", "unit", "fp1", "lang_pred", "_gone", "part"]
    docs = (no_docs if empty else odd_docs.unionByName(odd_docs.limit(2), allowMissingColumns=True))
    docs = docs.select(*[c for c in docs.columns if c not in clash], *[F.lit(k).alias(c) for k, c in enumerate(clash)])
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.when(F.length("text") > 3, "en"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.stored(stage(spark, docs, ""), "stage")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.count() <= docs.count()
            assert out.selectExpr(*[f"`{c}` as x{i}" for i, c in enumerate(clash)]).distinct().count() <= 1
        docs = out
    assert (docs.count() == 0) >= empty


PROSE = "The river rose in the night, and by morning the lower meadows stood under a foot of brown water. Nobody had seen it coming, least of all those who had built there. "


@pytest.mark.parametrize("share", [0.5, 2, 6])
@pytest.mark.parametrize("article", ["<article>{}</article>", "<main>{}</main>", "<div class='post comments-open'>{}</div>", "<div>{}</div>"])
@pytest.mark.parametrize("around", ["<section class='comments'>{}</section>", "<div id='comments'><ul>{}</ul></div>", "<div class='below'>{}</div>", "inside"])
def test_comments_go_whatever_their_share(share, article, around):
    body = [f"{PROSE}{k} times it had been foretold." for k in range(2)]
    said = [f"I lived there once, and {k} of my neighbours still do. {PROSE}" for k in range(int(2 * share))]
    each = "".join(f"<article class='comment'><p>{c}</p></article>" if around == "<div class='below'>{}</div>" else f"<div class='comment-body'><p>{c}</p></div>" for c in said)
    text = "<h1>The flood</h1>" + "".join(f"<p>{b}</p>" for b in body)
    inner = article.format(text + (f"<div class='comment-list'>{each}</div>" if around == "inside" else "")) + ("" if around == "inside" else around.format(each))
    page = f"<html><body><header><a href=/>Home</a></header>{inner}<footer>All rights reserved.</footer></body></html>"
    got = html_mincut.main_text(page).split("\n\n")
    assert got[-2:] == [" ".join(b.split()) for b in body] and not any("neighbours" in g for g in got)
