"""Operators over tables: the join, top-k, pages, chat, the pipeline, the registered queries."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, components, queries, simjoin, tables, topk, webpages
from lodestone.llm.tables import Scratch

# The join.


def by_brute_force(docs, threshold=0.8):
    """doc index -> (class, links) over (id, text) rows."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent, links = list(range(len(docs))), [0] * len(docs)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in {(a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :]}:
        both = len(sets[i] & sets[j])
        if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(docs)):
        members[find(i)].append(i)
    least = {}
    for own in members.values():
        ids = [docs[i][0] for i in own]
        for i in own:
            least[i] = docs[i][0] if len(own) == 1 else min((x for x in ids if x is not None), default=None)
    return [(docs[i][0], least[i], links[i]) for i in range(len(docs))]


def near_copies(seed, groups=25, most=30):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(4000)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    docs, i = [], 0
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 250))] + (shared if g % 3 == 0 else [])
        for _ in range(rng.randint(1, most)):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 9))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((i, " ".join(words)))
            i += 1
    return docs


def test_no_bin_has_two_near_copies(spark, tmp_path):
    """The registered packing over near copies of different sources, texts without words, repeated rows."""
    docs = near_copies(12, groups=10, most=12) + STRANGE
    rows = [(i, t, f"s{k % 9}") for k, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    classes = {i: c for (i, _), (_, c, _) in zip(docs, by_brute_force(docs))}
    bins, seen = defaultdict(list), Counter()
    for r in queries.op3_best_fit_packing(spark, f"file://{tmp_path}").collect():
        bins[r.bin_id].append(r)
        seen[r.doc_id] += r.piece == 0
    assert seen == Counter(i for i, _ in docs)
    texts = {i: t for i, t in docs}
    for own in bins.values():
        of = [classes[r.doc_id] for r in own if r.doc_id is not None and (texts[r.doc_id] or "").strip()]
        assert len(of) == len(set(of)) and sum(r.piece_size for r in own) <= queries.BIN_WORDS
    assert len(set(classes.values())) < 0.6 * len(docs)


STRANGE = [(900, None), (901, ""), (902, " \n"), (903, " \n"), (904, "a b"), (905, "a b"), (906, "a  b"), (None, "a b c d e f g"), (None, "a b c d e f g"), (907, "a b c d e f g"), (908, "q " * 40_000), (909, "q " * 40_001)]


@pytest.mark.parametrize("plan", [simjoin.JoinPlan(), simjoin.JoinPlan(small=4, block_rows=8, block_shingles=900, broadcast_keys=0, hot=3), simjoin.JoinPlan(small=4, block_rows=8, hot=3)])
def test_join_is_brute_force(spark, plan):
    docs = near_copies(11) + STRANGE
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_links long, node string").repartition(5)
    got = Counter(map(tuple, simjoin.jaccard_join(df, plan).collect()))
    assert got == Counter(by_brute_force(docs))


def test_join_of_large_groups(spark):
    """A large group of near copies, one of copies, and a passage that all share."""
    rng = random.Random(2)
    base, passage = [f"w{i}" for i in range(120)], " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(base[:60] + [f"x{rng.randint(0, 9)}"] + base[61:])) for i in range(300)] + [(1000 + i, "the same words in each of these texts") for i in range(400)]
    docs += [(2000 + i, passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(80))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plan = simjoin.JoinPlan(small=32, block_rows=64)
    assert Counter(map(tuple, simjoin.jaccard_join(df, plan).collect())) == Counter(by_brute_force(docs))


def test_texts_with_one_hash_stay_apart(spark, monkeypatch):
    docs = near_copies(13, groups=8, most=6) + STRANGE[:10]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simjoin, "text_hash", lambda text: F.length(text).cast("long") % 3)
    assert Counter(map(tuple, simjoin.jaccard_join(df).collect())) == Counter(by_brute_force(docs))
    classes = {c for (_, c, _), (_, t) in zip(by_brute_force(docs), docs) if (t or "").strip()}
    assert {r.doc_id for r in simjoin.one_of_each_class(df).collect() if (r.text or "").strip()} == classes


def test_one_of_each_class(spark):
    docs = near_copies(12, groups=12) + STRANGE
    df = spark.createDataFrame([(i, t, "n", "k") for i, t in docs], "doc_id long, text string, n string, `k.dot` string")
    got = simjoin.one_of_each_class(df)
    classes = {c for (i, c, _), (_, t) in zip(by_brute_force(docs), docs) if (t or "").strip()}
    assert got.columns == df.columns
    kept = [r.doc_id for r in got.collect() if (r.text or "").strip()]
    assert sorted(kept) == sorted(classes)
    assert sorted(r.doc_id for r in got.collect() if not (r.text or "").strip()) == [900, 901, 902, 903]
    assert simjoin.jaccard_join(df.filter("false")).count() == 0 and simjoin.one_of_each_class(df.filter("false")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000 + rng.randint(0, 80), 1000 + rng.randint(0, 80)) for _ in range(50)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# Top-k.


def top_by_loop(rows, k, asks, dim_of=len):
    own = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if i is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    out = Counter()
    for n, (q, v) in enumerate(own):
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(own) if m != n and len(w) == len(v))[:k]
            out.update((q, r, i, -s) for r, (s, i) in enumerate(scored, 1))
    return out


@pytest.mark.parametrize("blocks", [topk.Blocks(), topk.Blocks(candidates=16, queries=4, segments=(8, 2)), topk.Blocks(candidate_bytes=1000, query_bytes=200, candidates=8, queries=2), topk.Blocks(segments=())])
def test_top_k_is_the_loop(spark, blocks):
    rng = random.Random(6)
    draw = lambda n: [rng.choice((0.0, 0.25, -0.5, rng.gauss(0, 1))) for _ in range(n)]
    rows = [(i, draw(20)) for i in range(150)] + [(200 + i, [0.5] * 20) for i in range(40)] + [(300, None), (None, draw(20)), (301, [1.0, None] * 10), (302, [float("nan")] * 20), (303, [float("inf")] * 20), (5, draw(20)), (5, five := draw(20)), (5, five)]
    rows += [(500, draw(20)), (500, five), (500, five), (510, [3.0] * 20), (510, [3.0] * 20), (510, [3.0] * 20), (511, [3.0] * 20), *[(512, [2.0] * 20)] * 9, (520, [300.0] * 20)]
    rows += [(400, []), (410, []), (420, [1.0, 2.0]), (430, [1.0, 3.0]), (440, [7.0])]
    df = spark.createDataFrame([(i, v, 1, 1.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = Counter(map(tuple, topk.exact_top_k(df, 5, F.col("vec_id") % 10 == 0, blocks=blocks).collect()))
    assert got == top_by_loop(rows, 5, lambda i: i % 10 == 0)
    assert topk.exact_top_k(df.filter("false"), 5, F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_with_large_numbers(spark):
    rows = [(i, [float((i * 7919 + j * 104729) % 1000003) for j in range(12)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, topk.exact_top_k(df, 3, F.col("vec_id") % 10 == 0).collect())) == top_by_loop(rows, 3, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="too large"):
        topk.exact_top_k(spark.createDataFrame([(0, [1e17]), (1, [1e17])], df.schema), 3, F.col("vec_id") % 10 == 0).collect()


# Pages.


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("<article><h1>T </h1><p><b>x &quo &#233;<br><p>y\n z</article><footer>f", "T\nx &quo é\ny z"),
        ("<nav><li>n</nav><main><div class='ad-box'>buy</div><p>keep</p><form>f<input></form><script>var a='<p>';</script></main>", "keep"),
        ("<div id=content><p>one</p><div class=comments><p>bad</p></div></div><p>out</p>", "one"), ("<body><aside>s</aside><p>t<!-- c <p>x --></p><p hidden>h</p>", "t"),
        ("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a\nb\nc\n1\n2\n3"), ("<article><p>cut here <a href='x", "cut here"), ("<article>a<br>b<hr>c</article>", "a b\nc"),
        ("<header><h1>h</h1></header><article><header>h</header><p>x</p></article><article><header><h2>t</h2></header><p>y</p></article>", "x\nt\ny"), ("<p>a</b></i></p></div>b", "a\nb"), ("<title>t</title><style>s</style><p>z", "z"), ("<p>a&nbsp;&nbsp;b　c</p>", "a b c"),
        ("<article><blockquote>q</blockquote><pre>p  p</pre></article>", "q\np p"), ("a < b and 3 > 2", "a < b and 3 > 2"),
        ("<article><p class='market-share'>a</p><p id='comment-on-law'>b</p><section class='social'><p>c</p></section><p>x<sup><math><mi>y</mi></math></sup></p></article>", "a\nb\nc\nxy"),
        ("<article><div class='share-buttons'>s</div><div class='post-nav'>n</div><p>a &am<b>p;</b> &amp;<i>lt;</i> b</p><p style='color:red; display:none'>h</p></article>", "a &amp; &lt; b"),
        ("<form><h1>t</h1><p>all in a form</p><form><input>q</form></form>", "t\nall in a form"), ("<p title=it's>one</p><p title='a>b'>two</p>", "one\ntwo"),
    ],
)
def test_main_text(page, want):
    assert webpages.main_text(page, set()) == want


@pytest.mark.parametrize(
    "attributes",
    [
        'style="overflow:hidden"', 'style="visibility: hidden"', "title='the hidden gem'", 'href="/p?id=ads"', 'data-x="a class=nav b"', "title=hidden", 'data-hidden data-role="menu"', 'alt="say id=ads" class="wide"', 'title="a"class="wide"',
        'aria-hidden="false"', "style='role=navigation hidden'/",
    ],
)
def test_values_of_attributes_are_no_attributes(attributes):
    assert webpages.main_text(f"<div {attributes}><article><p>kept</p></article></div>", set()) == "kept"


@pytest.mark.parametrize("attributes", ["hidden", 'title="a" HIDDEN', "aria-hidden = 'true'", 'title="x"class="nav"', "id=ads", 'style="a:b" role=navigation', 'class="hidden menu"', "hidden/"])
def test_attributes_hide(attributes):
    assert webpages.main_text(f"<p>seen</p><div {attributes}>gone</div>", set()) == "seen"


@pytest.mark.parametrize("sent", [0, 1000])
def test_templates_are_removed(spark, sent):
    box = "<div><p>Join us today</p></div>"
    rows = [(i, f"https://a.org/{i}", f"<body>{box}<p>own {i}</p><div>odd {i}</div></body>") for i in range(30)]
    rows += [(100 + i, f"https://b.org/{i}", f"<article>{box}<p>Quoted by all</p><p>text {i}</p></article>") for i in range(30)]
    rows += [(200, "https://c.org/x", f"<body>{box}</body>"), (201, None, None), (202, "::", "<p>x"), (1, "https://a.org/1", rows[1][2])]
    rows += [(300 + i, "https://d.org/", "<body><div>all the same</div></body>") for i in range(25)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, page long")
    got = [tuple(r) for r in webpages.extract_pages(df, sent_templates=sent).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, _, t, n in got)
    text = {i: t for i, _, t, _ in got}
    assert text[3] == "own 3\nodd 3" and text[103] == "Quoted by all\ntext 3" and text[200] == "Join us today" and text[201] == "" and text[202] == "x" and text[305] == "all the same"
    assert sum(i == 1 for i, *_ in got) == 2
    assert webpages.extract_pages(df.filter("false")).count() == 0


def test_pages_of_the_test_data(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in webpages.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect():
        article = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        parts = (" ".join(html.unescape(x).split()) for x in re.split("<[^>]*>", article))
        assert r.text == "\n".join(x for x in parts if x)


@pytest.mark.parametrize("tags", [("<div>", "</div>"), ("<header>", "</header>"), ("<table><tr><td>", "</td></tr></table>"), ("<ul><li>", "</li></ul>"), ("<form>", "</form>"), ("<i>", "</i>")])
def test_nested_closed_tags_take_linear_time(tags):
    began = time.perf_counter()
    page = "<article>" + tags[0] * 40_000 + "x" + tags[1] * 40_000 + "<p>y</p></article>"
    text = webpages.main_text(page, {1})
    assert text.split() == (["y"] if tags[0] in ("<header>", "<form>") else ["x", "y"])
    assert time.perf_counter() - began < 10  # about 1 s on an idle machine


def test_templates_by_share_of_a_large_host(spark):
    """A subtree on 20 pages is a template of a host of 100 pages, not of one of 5,000."""
    rows = [(i, f"https://{h}.org/{i}", f"<body><div>box {h}</div><p>text {h} {i}</p></body>" if i < 20 else f"<body><p>text {h} {i}</p></body>") for h, n in (("a", 100), ("b", 5000)) for i in range(n)]
    got = {(r.url, r.text) for r in webpages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).filter("page_id = 3").collect()}
    assert got == {("https://a.org/3", "text a 3"), ("https://b.org/3", "box b\ntext b 3")}


def test_very_deep_and_long_pages():
    assert webpages.main_text("<div>" * 20_000 + "deep", set()) == "deep"
    assert webpages.template_hashes("<div>" * 3_000 + "x")
    assert webpages.main_text("<article>" + "<p>word word</p>" * 20_000, set()).count("\n") == 19_999


# Chat.


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|turn|><|end|>\n", "a\\-b\\\\-", "\\", "[INST", "<<SYS>>x<</SYS>>", "<</s>/s>", "é 🙂 ", "<|end|", "\n\n", "[[INST]]", "$1 \\1 $0"]


def test_chat_round_trip(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(("user", "assistant", "system", None, "odd role\n")), rng.choice([*TEXTS, None])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(1, 0, "user", "again"), (1, 0, "user", "again"), (2, None, "user", "first"), (None, 0, "assistant", "null id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.render(chat.turns_from_table(df)).cache()
    for r in formatted.collect():
        body = r.formatted
        for c in chat.CONTROLS:
            if c not in (chat.TURN, chat.END):
                assert c not in body
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    digests = {r.conv_id: r for r in chat.chat_digests(formatted).collect()}
    for c, own in want.items():
        own.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in own]
        loss = "".join(x for _, role, x in own if role == "assistant")
        d = digests[c]
        assert "".join(got[c].loss_texts) == loss and d.loss_chars == len(loss) and d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and d.n_turns == len(own)
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
    assert chat.chat_digests(chat.render(chat.turns_from_table(df.filter("false")))).count() == 0


def test_rows_without_an_id_and_long_conversations(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b")] + [(7, i, ("user", "assistant")[i % 2], f"turn {i} [INST]") for i in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {(r.conv_id, r.n_turns, r.loss_chars, r.turns_sha256) for r in chat.chat_digests(chat.render(chat.turns_from_table(df))).collect()}
    of = lambda own: hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
    assert got == {(None, 1, 0, of(rows[:1])), (None, 1, 1, of(rows[2:3])), (7, 20_000, sum(len(x) for _, _, r, x in rows[3:] if r == "assistant"), of(rows[3:]))}
    assert chat.chat_digests(chat.render(chat.turns_from_table(df))).filter("conv_id IS NULL").count() == 3


def test_record_layouts(spark):
    records = {
        1: '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b","extra":1}],"id":9}', 2: '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        3: '{"prompt":"a","completion":"b"}', 4: '{"instruction":"a","input":"x","output":"b","source":"s"}', 5: '{"instruction":"a","output":"b"}', 6: '{"question":"a","answer":"b"}',
        7: '{"system":"s","prompt":"a","response":"b"}', 8: '{"messages":[]}', 9: "not json", 10: None, 11: '{"other":1}', 12: '{"turns":[{"role":"user","text":null}]}', 13: '{"instruction":"a","input":"","output":"b"}',
    }
    df = spark.createDataFrame(list(records.items()), "conv_id long, record string")
    got = defaultdict(list)
    for r in chat.turns_from_table(df).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    plain = [("user", "a"), ("assistant", "b")]
    assert got == {1: plain, 2: plain, 3: plain, 4: [("user", "a\n\nx"), ("assistant", "b")], 5: plain, 6: plain, 7: [("system", "s"), *plain], 12: [("user", None)], 13: plain}
    assert sorted(r.conv_id for r in chat.unmapped_records(df).collect()) == [8, 9, 10, 11]
    with pytest.raises(ValueError):
        chat.turns_from_table(spark.range(1))
    assert chat.fingerprint(["b", "a", "a"]) == chat.fingerprint(["a", "b"])


# Registered queries.

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    from compare import plain

    df = queries.QUERIES[name](spark, sf_dir)
    got = sorted(repr(sorted(zip(df.columns, map(plain, r)))) for r in df.collect())
    assert got
    if name in queries.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        cur = con.execute(queries.SQL[name])
        cols = [c[0] for c in cur.description]
        assert got == sorted(repr(sorted(zip(cols, map(plain, r)))) for r in cur.fetchall())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before, scratch = docs.columns, docs.count(), Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
        if name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(n == 0 for _, _, n in by_brute_force(rows))
    bins = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in bins.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_with_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    import corpus_pipeline

    rng = random.Random(12)
    names = ["row", "node", "n", "k", "k.dot", "words", "label", "size", "shard", "clash", "check"]
    text = lambda i: " ".join(rng.choice(("the", "port", "sea", "ship", "crane", "pier", "buoy", f"x{i}", "mail a@b.org", "4111 1111 1111 1111")) for _ in range(60))
    rows = [(i, text(i), "en", "s", 9, *["c"] * len(names)) for i in range(60)] + [(None, "null id " * 8, None, None, None, *[None] * len(names))] * 2
    rows += [(100, None, None, None, None, *[None] * len(names)), (101, "", "en", "s", 0, *["c"] * len(names)), (102, "q " * 60_000, "en", "s", 1, *["c"] * len(names)), (103, rows[0][1], "fr", "s", 1, *["d"] * len(names))] + [rows[5]] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    for name, docs, labels in (("odd", rows, [(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (3, 1, 0), (4, 1, None), (5, 1, 0)]), ("empty", [], [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        bins = corpus_pipeline.run(spark, folder)
        got = bins.collect()
        assert bins.columns == ["doc_id", "piece", "piece_start", "piece_size", "bin_id", "bin_offset"] and (not docs) == (not got)
    stage = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), "")
    kept = Counter(r.doc_id for r in stage.collect())
    assert stage.columns == spark.createDataFrame([], schema).columns and kept[None] == 1 and kept[103] == 0 and kept[5] == 1 and kept[100] == kept[101] == kept[102] == 1


def test_one_label_an_id_and_one_shared_folder(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(7, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(7, 0), (9, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: (r.label, r.text) for r in tables.labelled_sample(docs, labels, "toxic", 100).collect()}
    assert got[7] == (0, "a") and got[9][0] == 0 and got[11][0] == 1 and None not in got
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in got)
    first = [r.doc_id for r in tables.labelled_sample(docs, labels, "toxic", 10).collect()]
    rest = [r.doc_id for r in tables.labelled_sample(docs, labels, "toxic", 100, 10).collect()]
    assert len(first) == 10 and sorted(first + rest) == sorted(got)

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Elsewhere())
    scratch = Scratch(spark, "test")
    a, b = scratch.cut(spark.range(3)), scratch.cut(spark.range(4))
    scratch.clear(keep=1)
    assert b.count() == 4
    with pytest.raises(Exception, match="(?i)exist"):
        a.count()


def test_spread_join_is_a_join(spark):
    rng = random.Random(15)
    rows = [(rng.choice((1, 1, 1, 2, 3, None, 9)), i) for i in range(400)]
    left = spark.createDataFrame(rows, "k long, node long")
    for how in ("inner", "left"):
        facts = Scratch(spark, "test").cut(left.filter("k < 9").groupBy("k").agg(F.count(F.lit(1)).alias("n")))
        want = Counter(map(tuple, left.join(facts, "k", how).select("k", "node", "n").collect()))
        for hot, keys in ((5, 100), (5, 0), (10_000, 0), (0, 0), (0, 100)):
            assert Counter(map(tuple, tables.spread_join(left, facts, "k", "node", how, hot, keys).select("k", "node", "n").collect())) == want


def extracted_by_marks(page):
    """The text of a page made by the next test: what stands between kept marks, block by block."""
    return "\n".join(" ".join(x.split()) for x in re.findall(r"\x01(.*?)\x02", page, re.DOTALL) if x.strip())


def test_made_pages_against_their_marks(spark):
    """Pages of three hosts with templates, furniture by names and prose that recurs; kept blocks carry marks."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    some = lambda n: " ".join(word() for _ in range(n))
    quoted = some(20)
    rows, want = [], {}
    for i in range(150):
        host = ("a.org", "b.org", "c.org")[i % 3]
        keep = lambda x: f"\x01{x}\x02"
        blocks_ = [f"<h2>{keep(some(3))}</h2>", f"<p>{keep(some(12))}</p>", f"<ul><li>{keep(some(2))}</li><li>{keep(some(2))}</li></ul>", f"<p>{keep(quoted)}</p>", f"<table><tr><td>{keep(some(1))}</td><td>{keep(some(1))}</td></tr></table>",
                   f"<p class='market-share'>{keep(some(6))}</p>", f"<blockquote>{keep(some(5))}</blockquote>"]
        junk = ["<section id='comments'><h2>Said</h2><p>by readers</p></section>", f"<ul id='menu'><li>{some(2)}</li></ul>", f"<div id='sidebar'>{some(2)}</div>"] + [f"<div class='{c}'><p>{some(4)}</p></div>" for c in ("ad", "share-buttons", "newsletter", "comments", "post-nav")] + [f"<nav>{some(3)}</nav>", f"<aside>{some(3)}</aside>", f"<form>{some(2)}<input></form>", "<script>var x='<p>';</script>"]
        if i % 2:  # in an article, ids are made of headings
            name = rng.choice(("search", "comments", "notices", "related", "menu", "banner"))
            blocks_ += [f"<h3 id='{name}'>{keep(some(2))}</h3>", f"<section id='{rng.choice(('overlay', 'navigation', 'search', 'alerts'))}'><h2>{keep(some(2))}</h2><p>{keep(some(9))}</p></section>", f"<p id='{name}'>{keep(some(7))}</p>"]
        else:
            del blocks_[3]  # without a content element nothing tells a quoted passage from a template
        body = rng.sample(blocks_, 5) + rng.sample(junk, 4)
        rng.shuffle(body)
        title = f"<h1>{keep(some(4))}</h1>"
        box = f"<div class='box'><p>about {host}</p><div>more of {host}</div></div>"
        inner = "".join([title, *body])
        page = f"<html><head><title>t</title></head><body><div>menu of {host}</div>" + (f"<article>{inner}</article>" if i % 2 else inner) + box + f"<footer>{some(2)}</footer></body></html>"
        want[i] = extracted_by_marks(page)
        rows.append((i, f"https://{host}/{i}", page.replace("\x01", "").replace("\x02", "")))
    got = {r.page_id: r.text for r in webpages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
