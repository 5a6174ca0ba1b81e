"""Operators over whole tables: near-duplicates, mixing, templates, classifier, pipeline."""

import random
import shutil
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.llm import cotraining, html_text, mixing, simhash
from tabloom.llm.html_text import Page

SF = "/root/testdata/sf0.001"


def brute_components(values, radius=4):
    left, out = set(values), {}
    while left:
        todo, own = [left.pop()], set()
        while todo:
            x = todo.pop()
            own.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            todo += near
        for x in own:
            out[x] = frozenset(own)
    return out


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_layout_and_ball():
    for segments in (1, 2, 3, 4, 5, 7):
        parts = simhash.layout(segments, 4)
        assert sum(r + 1 for _, _, r in parts) > 4  # the pigeonhole: distances beyond all balls sum over the radius
    assert len(simhash.ball(22, 1)) == 23 and len(simhash.ball(32, 2)) == 1 + 32 + 496


@pytest.mark.parametrize("segments", [2, 3])
def test_components_equal_brute_force(spark, segments):
    rnd = random.Random(5)
    values = {rnd.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for center in list(values)[:12]:  # crowds around one value, and chains
        x = center
        for _ in range(25):
            values.add(center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))))
            x ^= sum(1 << b for b in rnd.sample(range(64), 4))
            values.add(x)
    ids = {v: n for n, v in enumerate(sorted(values))}
    df = spark.createDataFrame([(n, signed(v)) for v, n in ids.items()] + [(n + 5000, signed(v)) for v, n in ids.items()], "doc_id long, fp long")
    want = brute_components(values)
    for r in simhash.grouped(df, 4, segments).collect():
        assert r["component_id"] == min(ids[v] for v in want[r["fp"] % (1 << 64)])


def test_fingerprint_edge_cases(spark):
    rows = [(3, None), (4, ""), (5, " \t\n"), (7, "Word"), (8, "word"), (9, "a b c d e f g"), (None, "word"), (9, "a b c d e f g"), (11, " ".join(str(i) for i in range(70_000)))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    assert by[3][1:] == by[4][1:] == by[5][1:] == ("0" * 16, 3) and by[7][1:] == by[8][1:] and by[None][2] == 7
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = [r["doc_id"] for r in simhash.without_copies(df).collect()]
    assert sorted(kept) == [3, 7, 9, 11]


def similarity(a, b):
    x, y = (set(simhash.shingles(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_stage_links_similarity_of_0_8(spark):
    rnd = random.Random(11)
    texts = []
    for _ in range(60):  # a text, and one of similarity 0.8 or a little more that SimHash puts over 4 bits away
        words = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        other = list(words)
        for at in rnd.sample(range(0, 200, 10), 4):
            other[at] = f"v{rnd.randrange(5000)}"
        texts += [" ".join(words), " ".join(other)]
    texts += [" ".join(f"u{i}" for i in range(k, k + 100)) for k in (0, 8, 16, 24, 50)]  # a chain of 0.85 each, and one alone
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if similarity(texts[i], texts[j]) >= 0.8]
    assert len(pairs) >= 63 and sum((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 4 for i, j in pairs) > 30
    above = {j for _, j in pairs}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.without_copies(df).collect()) == [i for i in range(len(texts)) if i not in above]


def test_bitmaps_differ_in_no_more_than_the_sets():
    rnd = np.random.default_rng(3)
    for n in (1, 5, 200, 3000):
        for share in (0.0, 0.1, 0.5, 1.0):
            x = np.unique(rnd.integers(0, 1 << 64, n, np.uint64))
            y = np.unique(np.concatenate([x[int(share * len(x)) :], rnd.integers(0, 1 << 64, int(share * n), np.uint64)]))
            bits = (simhash.bitmap(x) ^ simhash.bitmap(y)).view(np.uint64)
            assert sum(int(b).bit_count() for b in bits) <= len(np.setxor1d(x, y))


def test_stage_on_a_crowd_just_below_0_8_equals_brute_force(spark):
    rnd = random.Random(17)
    base = [f"w{rnd.randrange(9000)}" for _ in range(200)]
    texts = []
    for n in range(120):  # four to seven edits of few places, so that copies are alike to some others and not to the base
        words = list(base)
        for at in rnd.sample(range(0, 200, 14), rnd.choice((4, 5, 6, 7))):
            words[at] = f"v{at}" if rnd.random() < 0.8 else f"v{n}"
        texts.append(" ".join(words))
    texts += [" ".join(base), " ".join(base), " ".join(base[:3]), " ".join(base[:3])]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    prints = [simhash.fingerprint(t) for t in texts]
    for j in range(len(texts)):
        for i in range(j):
            if (prints[i] ^ prints[j]).bit_count() <= 4 or similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    want = [i for i in range(len(texts)) if top(i) == i]
    assert 3 <= len(want) < 60 and sum(similarity(t, texts[120]) < 0.8 for t in texts[:120]) > 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.without_copies(df).collect()) == want


@pytest.fixture
def no_broadcast(spark):
    """Spark's own limit for broadcasts, and any that is made fails."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.maxBroadcastTableSize": "1b"}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k in own:
        spark.conf.unset(k)


def near_texts(n=40):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(n)]
    return [(i, x) for i, x in enumerate(y for x in texts for y in (x, x, x.rsplit(" ", 2)[0]))]


def test_stage_broadcasts_nothing(spark, no_broadcast):
    df = spark.createDataFrame(near_texts(), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.without_copies(df).collect()) == list(range(0, 120, 3))


def test_components_broadcast_nothing(spark, no_broadcast):
    df = spark.createDataFrame(near_texts(), "doc_id bigint, text string")
    rows = simhash.near_duplicates(df).collect()
    values = brute_components(int(r["fingerprint"], 16) for r in rows)
    least = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        least.setdefault(values[int(r["fingerprint"], 16)], r["doc_id"])
    assert all(r["component_id"] == least[values[int(r["fingerprint"], 16)]] for r in rows) and len(rows) == 120


def test_stage_keeps_unrelated_rows_of_one_id(spark):
    words = lambda seed: " ".join(f"w{random.Random(seed * 1000 + i).randrange(10**6)}" for i in range(60))
    texts = [words(k) for k in range(8)]
    rows = [(None, texts[k], "s") for k in range(4)] + [(7, texts[4], "s"), (7, texts[5], "s"), (7, texts[5], "s"), (8, texts[6], "s"), (None, texts[6], "s"), (9, texts[7], "s"), (9, texts[7], "t"), (3, texts[0], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["doc_id"], r["text"]) for r in simhash.without_copies(df).collect()]
    assert sorted(got, key=str) == sorted([(3, texts[0]), *((None, texts[k]) for k in (1, 2, 3)), (7, texts[4]), (7, texts[5]), (8, texts[6]), (9, texts[7])], key=str)
    assert simhash.without_copies(df.limit(0)).count() == 0


def test_last_stage_follows_the_mix(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {r["doc_id"]: r["position"] for r in mixing.schedule(docs).collect()}
    rows = sorted(c.best_fit_packing(spark, c.source_mixing(spark, docs, SF), SF).collect(), key=lambda r: r["sequence_id"])
    firsts = [at[r["doc_id"]] for r in rows if r["offset"] == 0]
    assert firsts == sorted(firsts)


def brute_period(p, slots):
    done, out = [0] * len(p), []
    for t in range(slots):
        ready = [(-(-(k + 1) * slots // x), i) for i, (x, k) in enumerate(zip(p, done, strict=True)) if k < x and k * slots // x <= t]
        i = min(ready)[1]
        out.append((i, done[i]))
        done[i] += 1
    return out


def test_pfair_schedule(spark):
    """A hot source, some hundred small ones and a tiny one over several periods: equal to brute force, and never off the exact weight by a block."""
    rnd = random.Random(4)
    weights = {"hot": 1 / 3, "tiny": 1e-3, **{f"s{i:03}": rnd.uniform(0.5, 2) / 400 for i in range(120)}}
    rows = spark.createDataFrame([(f"={k}", w) for k, w in weights.items()], "source string, weight double")
    quota = mixing.quotas(rows, 300)
    one = quota.first()
    v = [b - a for a, b in zip(one["cums"], one["cums"][1:])]  # noqa: B905
    slots, many = one["slots"], 3
    assert slots >= 300 and all(2 * one["total"] <= x * slots for x in v)
    exact = {f"={k}": w / sum(weights.values()) for k, w in weights.items()}
    assert all(abs(x / one["total"] - exact[name]) < 1e-5 for name, x in zip(one["names"], v, strict=True))
    got = sorted(((r["slot"], r["source"], r["block"], r["release"], r["deadline"]) for r in mixing.periods(quota, many).collect()))
    assert [g[0] for g in got] == list(range(many * slots)) and all(g[3] <= g[0] < g[4] for g in got)  # every window is met
    had = [0] * len(v)
    for q in range(many):
        now = [(q + 1) * slots * c // one["total"] for c in one["cums"]]
        p = [b - a - h for a, b, h in zip(now, now[1:], had)]  # noqa: B905
        want = [(one["names"][i], had[i] + k) for i, k in brute_period(p, slots)]
        assert [(g[1], g[2]) for g in got[q * slots : (q + 1) * slots]] == want
        had = [h + x for h, x in zip(had, p, strict=True)]
    for i, name in enumerate(one["names"]):  # a slot is half a block
        n = 0
        for t in range(many * slots + 1):
            assert abs(Fraction(n) - Fraction(t * v[i], one["total"])) < 2
            n += t < len(got) and got[t][1] == name


def test_mix_of_many_sources(spark):
    rows = spark.range(12_000).selectExpr("id as doc_id", "concat('s', id % 1500) as source", "repeat('x', cast(id % 90 as int)) as text")
    got = mixing.schedule(rows, block=100, period=64).collect()
    assert sorted(r["position"] for r in got) == list(range(12_000)) and all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_mix_keeps_every_row(spark):
    rows = [(i, "x" * (i % 50), None if i % 7 == 0 else ["s0", "s1", "s2", "", "s2"][i % 5], "z", "a", None) for i in range(300)] + [(None, None, "s1", "z", "b", 1), (5, "xxxxx", "s0", "z", "c", 2), (5, "xxxxx", "s0", "z", "c", 2), (None, None, None, "y", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, position string, _id string, _position long")
    weights = {"s0": 1.0, "s1": 2.0, "s2": float("nan"), "absent": 5.0}
    got = mixing.schedule(df, weights, block=100, period=16).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows))) and all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    order = sorted(got, key=lambda r: r["position"])
    assert [r["slot"] for r in order] == sorted(r["slot"] for r in got)
    assert {r["source"] for r in got} == {None, "", "s0", "s1", "s2"} and all((r["source"] is None) == (rows[r["doc_id"]][2] is None) for r in got if r["doc_id"] not in (None, 5))
    out = mixing.mixed(df, weights, block=100, period=16)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert [r["doc_id"] for r in out.collect() if r["doc_id"] not in (5, None)] == [r["doc_id"] for r in order if r["doc_id"] not in (5, None)]
    assert mixing.schedule(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    single = mixing.schedule(df.where("source = 's0'"), block=100).collect()  # a source alone needs no schedule
    assert sorted(r["position"] for r in single) == list(range(len(single))) and all(r["release"] <= r["slot"] < r["deadline"] for r in single)
    with pytest.raises(TypeError):
        mixing.schedule(spark.createDataFrame([("a", "x", "s")], "doc_id string, text string, source string"))


PAGES = {
    '<body><header class="site-header"><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>Hello <b>wor</b>ld &amp; you.<p>Second<br>line<ul><li>one<li>two</ul><div class="ad-slot">BUY</div><section id="comments"><h2>Comments</h2><article class="comment"><p>nice</p></article></section></article><aside>x</aside></main><footer>f</footer></body>': "Title Hello world & you. Second line one two",
    "": "",
    '<p>a<!-- b --> c</p>d<script>var t="</p>";</script>e': "a c de",
    "<div>x<span hidden>no</span>y</div><table><tr><td>1<td>2<tr><td>3</table>": "xy 1 2 3",
    "<article><p>un<b>closed <p>next &copy; &#65;": "unclosed next © A",
    "a < b and <3": "a < b and <3",
    '<div class="article-header"><h1>T</h1></div><div class="cookie-notice">c</div><p>x</p>': "T x",
    '<p>a</p><textarea>zz</textarea><p title="a>b">c</p>': "a c",
}


def test_page_text():
    for source, want in PAGES.items():
        assert Page(source).text() == want
    assert len(Page("<p>w" * 50_000).text().split()) == 50_000
    assert Page("<div>" * 3000 + "x").text() == "x"


def test_site_templates_go_and_copies_stay(spark):
    strip = "<div><p>Follow us everywhere</p><p>Best offers today</p></div>"
    pages = [(i, f"http://h.example/{i}", f"<body>{strip}<div><p>Own words of page {i}.</p></div></body>") for i in range(30)]
    pages += [(100 + i, f"http://copies.example/{i}", "<body><p>The same article.</p><p>On every page.</p></body>") for i in range(30)]
    pages += [(200, None, None), (201, "http://h.example/0", pages[0][2])]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got[3] == "Own words of page 3." and got[100] == "The same article. On every page." and got[200] == "" and got[201] == got[0]
    assert html_text.main_text(df.limit(0)).count() == 0
    old, html_text.SMALL = html_text.SMALL, 0
    try:  # the salted join gives the same
        assert {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()} == got
    finally:
        html_text.SMALL = old


def test_furniture_goes_by_counts_alone(spark):
    """No telling names: what recurs on a host goes, equal to a count by brute force, and the blocks of each step are told."""
    rnd = random.Random(3)
    words = lambda n: " ".join(f"w{rnd.randrange(9000)}" for _ in range(n))
    rows, want = [], {}
    for h in range(4):
        top, side, end = ("".join(f"<div><span>{words(2)}</span></div>" for _ in range(5)) for _ in range(3))
        for i in range(25 if h else 3):  # too few pages on the first host
            own = [words(30) for _ in range(4)]
            body = "".join(f"<p>{x}</p>" for x in own)
            rows.append((len(rows), f"https://u@Host{h}.example:80/{i}", f"<body><div>{top}</div><table><tr><td>{side}</td><td>{body}</td></tr></table><nav>menu {i}</nav><div>{end}</div></body>"))
            want[rows[-1][0]] = " ".join(own) if h else None
    rows.append((len(rows), rows[-1][1], "<body>" + "<p>" + "long " * 300_000 + "</p></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.main_text(df).collect()}
    for k, text in want.items():
        assert text is None or (got[k]["text"] == text and got[k]["n_template"] == 15 and got[k]["n_listed"] == 1 and got[k]["n_blocks"] == 20)
    assert got[0]["n_template"] == 0 and got[rows[-1][0]]["n_chars"] == 1_499_999
    by: dict = {}
    for _, url, source in rows:
        page = Page(source)
        by.setdefault(url.split("@")[1].split(":")[0].lower(), {}).setdefault(page.text(), set()).update(page.hashes())
    brute = {(h, v) for h, texts in by.items() for v in set().union(*texts.values()) if sum(v in x for x in texts.values()) >= max(5, 0.1 * len(texts))}
    assert {(r["host"], v) for r in html_text.templates(df).collect() for v in r["hashes"]} == brute


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    model = cotraining.fit(docs, labels.where("doc_id % 4 <> 0"))
    rows = cotraining.score(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    right = np.mean([r["kept"] == (r["quality"] == 1) for r in rows])
    assert right >= 0.93 and np.mean([r["kept"] for r in rows if r["quality"] == 1]) >= 0.97
    assert cotraining.accepted(docs, labels).columns == docs.columns


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "x " * 100_000, "s"), (3, "x " * 100_000, "s"), (None, "y", "s")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = cotraining.classified(docs, none).collect()
    assert len(rows) == 5 and all(r["kept"] and r["score"] == 1.0 for r in rows)
    one = spark.createDataFrame([(1, 0), (1, 1), (3, None), (None, 1)], "doc_id long, quality int")
    assert cotraining.classified(docs, one).count() == 5 and cotraining.classified(docs.limit(0), one).count() == 0


def test_accepted_rows_stay_out_of_python(spark):
    """Kept rows equal those of score, whatever their ids and columns; nothing but a boolean comes back from Python."""
    docs, labels = (spark.read.parquet(f"{SF}/../sf0.01/{x}.parquet") for x in ("documents", "labels"))
    docs = docs.union(docs.where("doc_id < 100")).selectExpr("if(doc_id % 50 = 0, null, doc_id) doc_id", "if(doc_id % 70 = 0, null, text) text", "lang", "source", "n_chars", "array(doc_id) `_id.x`")
    got = cotraining.accepted(docs, labels)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    scores = cotraining.score(docs, cotraining.fit(docs, labels)).where("kept").groupBy("doc_id").count().collect()
    assert got.schema == docs.schema and got.exceptAll(docs).isEmpty()
    assert {(r[0], r[1]) for r in got.groupBy("doc_id").count().collect()} == {(r[0], r[1]) for r in scores}
    assert 0 < got.count() < docs.count() and cotraining.accepted(docs.limit(0), labels).count() == 0


def test_packing_leaves_no_words_in_the_workers(spark, tmp_path):
    """A Python worker outlives its stage: what it keeps stands beside what the next stages need."""
    from tabloom.llm import encoding, packing
    from tabloom.llm.queries import tokenizer

    path = shutil.copy(tokenizer("byte_bpe_50k.json"), tmp_path)

    def kept(batches):
        for _ in batches:
            own = encoding.encoder(path)
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(half) for x in (own.words, own.others, own.tails) for half in (x.young, x.old))])], ["n"])

    assert packing.token_pieces(spark.read.parquet(f"{SF}/documents.parquet").repartition(8), path, end_id=0).count() >= 200
    assert [r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(kept, "n bigint").collect()] == [0] * 8


def test_co_training_beats_its_round_0():
    """Views that are independent given the label: the few labelled rows leave much to learn from the others."""
    rnd = np.random.default_rng(1)
    gain = []
    for _ in range(5):
        y = (rnd.random(6000) < 0.5).astype(float)
        signs = rnd.normal(size=(2, 1, 20))
        content, metadata = (y[:, None] * s * 0.6 + rnd.normal(size=(6000, 20)) for s in signs)
        held = slice(4000, None)
        model = cotraining.CoTrained(content[:100], metadata[:100], y[:100])
        before = np.mean((model.scores(content[held], metadata[held])[2] > 0.5) == (y[held] > 0.5))
        for _ in range(cotraining.ROUNDS):
            model.step(cotraining.pool_sums(model.views, content[100:4000], metadata[100:4000], 0.9))
        after = np.mean((model.scores(content[held], metadata[held])[2] > 0.5) == (y[held] > 0.5))
        assert all(n > 0 for r in model.handed for n in (sum(r[:2]), sum(r[2:])))  # both ways
        gain.append(after - before)
    assert np.mean(gain) > 0.01 and min(gain) > 0


def test_a_round_equals_brute_force(spark):
    """Sums over partitions, added up in two levels, against one loop over the rows."""
    rnd = np.random.default_rng(2)
    y = (rnd.random(300) < 0.6).astype(float)
    content, metadata = (np.column_stack([y * 4 + rnd.normal(size=300), rnd.normal(size=300)]).astype("<f4").astype(float) for _ in range(2))
    model = cotraining.CoTrained(content[:60], metadata[:60], y[:60])
    rows = [(i, float(y[i]) if i < 60 else None, bytearray(content[i].astype("<f4").tobytes()), bytearray(metadata[i].astype("<f4").tobytes())) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, y double, content binary, metadata binary").repartition(7)
    got = cotraining._pooled(table, model)
    for view, mine, other in ((0, content, metadata), (1, metadata, content)):
        v, w = model.views[view], model.views[1 - view]
        for label in (0, 1):
            n, g, c = 0, np.zeros(3), np.zeros((3, 3))
            for i in range(60, 300):
                p = 1 / (1 + np.exp(-w.log_odds(other[i : i + 1])[0]))
                if (p if label else 1 - p) >= cotraining.SURE:
                    z = np.append((mine[i] - v.mean) / v.scale, 1.0)
                    q = 1 / (1 + np.exp(-(z @ v.w)))
                    n, g, c = n + 1, g + z * (label - q), c + np.outer(z, z) * max(q * (1 - q), 1e-6)
            assert got[2 * view + label][0] == n and np.allclose(got[2 * view + label][1], g) and np.allclose(got[2 * view + label][2], c)
    assert sum(x[0] for x in got) > 0 and all(n == 0 for n, _, _ in cotraining._pooled(table.limit(0), model))


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, sizes = docs, []
    for name, stage in c.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept <= {r["doc_id"] for r in before.select("doc_id").collect()}
        sizes.append(len(kept))
        before = after
    assert sizes == sorted(sizes, reverse=True)
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert len(kept & bad) <= 0.1 * max(1, len(bad))
    fps = [simhash.fingerprint(r["text"]) for r in before.collect()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
    rows = c.run(spark, SF)
    assert {r[0] for r in rows.select("doc_id").distinct().collect()} == kept
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _id long, _position long, _kept string, _q string, _key long, row string, key long, node long, fp long, id long, text2 string, position long, q string, own long"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named as the stages name theirs."""
    rnd = random.Random(8)
    plain = lambda n: "\n".join(" ".join(f"{rnd.choice('bcdfgh')}{rnd.choice('aeiou')}{rnd.choice('lmnr')}{rnd.randrange(900)}" for _ in range(15)) + "." for _ in range(n))
    texts = [plain(3) for _ in range(12)] + [plain(3000), "x" * 2_000_000, "", " \n ", None]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (100, texts[1], "en", "", None), (None, texts[2], None, None, None), (None, None, None, None, None), (7, plain(2), "en", "s1", 5)]
    more = [None if i % 4 == 0 else 3 if kind.endswith("long") else "z" for i, kind in enumerate(CLASHING.split(", ")[5:])]
    return spark.createDataFrame([(*r, *more) for r in rows], CLASHING), rows


def test_stages_on_odd_documents(spark, tmp_path):
    """No stage crashes, loses a column or makes a row up; each keeps what it does not reject, as many times as it is there."""
    import corpus_pipeline as c

    docs, rows = odd_documents(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {}
    for name, stage in c.STAGES[:-1]:  # each on its own input
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        found[name] = [tuple(r) for r in out.collect()]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    all_ = sorted(tuple(r) for r in docs.collect() if r["doc_id"] is not None)
    same = lambda got: sorted(r for r in got if r[0] is not None)
    assert same(found["quality_classifier"]) == all_ and len(found["quality_classifier"]) == len(rows)  # without labels, nothing goes
    assert same(found["source_mixing"]) == all_ and len(found["source_mixing"]) == len(rows)
    ids = lambda name: sorted(str(r[0]) for r in found[name])
    # rules: texts of fewer than ten words go; repeated rows stay
    assert ids("quality_rules") == sorted(map(str, [0, 0, 0, *range(1, 13), 7, 100, None]))
    # copies: one of the repeated rows, the smaller id of equal texts, an id before none; all texts without words are one
    assert ids("near_dedup") == sorted(map(str, [*range(14), 14, 7]))
    last = c.best_fit_packing(spark, docs, str(tmp_path)).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in last}) == len(last) and sum(r["piece"] == 0 for r in last) == len(rows)
    assert c.best_fit_packing(spark, docs.limit(0), str(tmp_path)).count() == 0
