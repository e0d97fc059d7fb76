"""Decontamination, language, pages, mixing, language model and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute, fixtures
from wattframe.llm import lm
from wattframe.llm.common import split_words
from wattframe.llm import decontaminate
from wattframe.llm.decontaminate import FOLD, benchmark_matches, edit_distances
from wattframe.llm.html import extract_main_text, main_text
from wattframe.llm.language import held_out, predict_language, temperature_for, train_language_model
from wattframe.llm.mixing import mixed, pfair_slots
from wattframe.llm.queries import source_targets

SMALL = "/root/testdata/sf0.001"


def folded(text):
    w = split_words([(text or "").encode().translate(FOLD)])
    return [bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends)]


def word_distance(item, words):
    """Least edit distance between the item and any run of the words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_benchmark_matches_equal_brute_force(spark):
    r = fixtures.random.Random(8)
    items = [fixtures.words(r, n) for n in (9, 12, 15, 20, 33, 33, 50)]
    docs = []
    for k in range(120):
        own = fixtures.words(r, r.randint(0, 60))
        if k % 2:
            item = r.choice(items)
            own += fixtures.edited(r, item, r.choice([0, 0, 0.05, 0.1, 0.2, 0.4]))[r.randint(0, 1) :]
        docs.append((k, " ".join(own + fixtures.words(r, r.randint(0, 60)))))
    docs += [(500, None), (501, ""), (502, "THE, " + ", ".join(items[2]).upper() + "!"), (503, " ".join(items[0] + items[3])), (502, "x")]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, ""), (52, "too short"), (1, "an item of the same id " * 3)]
    got = benchmark_matches(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    ).collect()
    found = Counter((x.id, m.item_id) for x in got for m in set(m.item_id for m in x.matches) and x.matches)
    want = Counter()
    for d, t in docs:
        for i, b in bench:
            own = folded(b)
            if len(own) >= 8 and word_distance(own, folded(t)) <= len(own) // 4:
                want[(d, i)] += 1
    assert set(found) == set(want) and len(want) > 40
    assert len(got) == len(docs)
    exact = next(x for x in got if x.id == 503).matches
    assert [(m.item_id, m.start, m.end, m.distance) for m in exact] == [(0, 0, 9, 0), (3, 9, 29, 0)]


def test_short_items_and_scripts_without_spaces_are_found(spark):
    items = [(1, "What is two plus two?"), (2, "日本の首都はどこですか。"), (3, "今天天气怎么样"), (4, "กรุงเทพมหานคร"), (5, "two plus")]
    docs = [
        (1, "Asked: what is TWO plus two, and why"), (2, "what is two plus three"), (3, "問い：日本の首都はどこですか、答え"),
        (4, "日本の首府はどこですか"), (5, "他问今天天气怎么样呢"), (6, "今天天气怎么"), (7, "ที่กรุงเทพมหานครนี้"), (8, "twoplus"),
    ]
    got = benchmark_matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    found = {x.id: {m.item_id for m in x.matches} for x in got}
    assert found == {1: {1, 5}, 2: {5}, 3: {2}, 4: {2}, 5: {3}, 6: set(), 7: {4}, 8: set()}


def test_edit_distance_to_a_prefix():
    item = np.array([[1, 2, 3, 4]], np.uint64)
    segment = np.array([[1, 9, 2, 3, 4, 7]], np.uint64)
    distance, size = edit_distances(item, segment)
    assert (distance[0], size[0]) == (1, 5)


def test_edit_distances_up_to_a_limit_equal_the_full_table():
    random = np.random.default_rng(4)
    for n, most in ((15, 3), (12, 0), (40, 10)):
        items = random.integers(1, 6, (400, n)).astype(np.uint64)
        segments = np.concatenate([items, random.integers(1, 6, (400, most)).astype(np.uint64)], axis=1)
        for row, edits in enumerate(random.integers(0, n, 400)):
            segments[row, random.integers(0, n + most, edits)] = 7
            segments[row] = np.roll(segments[row], random.integers(-1, 2))
        full, sizes = edit_distances(items, segments)
        distance, size = edit_distances(items, segments, most)
        near = full <= most
        assert 0 < near.sum() < 400
        assert (distance[near] == full[near]).all() and (size[near] == sizes[near]).all() and (distance[~near] == most + 1).all()
    short = edit_distances(items, segments[:, :20], 10)[0]
    assert (short == 11).all()


def test_items_are_embedded_once(monkeypatch):
    random = np.random.default_rng(5)
    item, other = (" ".join(f"w{k}" for k in random.integers(0, 10_000, 20)) for _ in range(2))
    groups = decontaminate.prepared([(1, item), (2, other)], 0.75, 8, 0.99)
    calls, real = [], decontaminate.embedded
    monkeypatch.setattr(decontaminate, "embedded", lambda *a: calls.append(1) or real(*a))
    found = decontaminate.find_items([f"one two {item} three".encode(), b"none", f"{other} {item}".encode()], groups)
    assert [[(m["item_id"], m["start"], m["distance"]) for m in f] for f in found] == [[(1, 2, 0)], [], [(2, 0, 0), (1, 20, 0)]]
    assert len(calls) == sum(len(g.tables) for g in groups)



def test_benchmark_on_odd_tables(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    nothing = items.where("false")
    docs = fixtures.documents(spark)
    assert benchmark_matches(fixtures.empty(spark), items).collect() == []
    got = benchmark_matches(docs, nothing, keep=("row", "block")).collect()
    assert len(got) == docs.count() and all(x.matches == [] and x.row == "a" for x in got)
    assert benchmark_matches(fixtures.with_null_ids(spark), items).count() == 34


def test_language_is_learned_and_held_out_rows_are_right(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    model = train_language_model(rows.where("NOT held_out"), per_language=60)
    got = predict_language(rows, model).collect()
    held = [x for x in got if x.held_out]
    assert {x.id for x in held} == {x.id for x in got if zlib.crc32(str(x.id).encode()) % 4 == 2}
    assert sum(x.lang == x.lang_pred for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in got)
    assert (model.weights == 0).mean() > 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 34"), (4, "é"), (None, "the " * 100_000)], "id long, text string")
    answers = {x.id: x for x in predict_language(odd, model).collect()}
    assert [answers[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and answers[1].score == 0
    assert answers[4].lang_pred in model.languages and answers[None].lang_pred in model.languages


def test_language_without_anything_to_learn(spark):
    none = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "id long, text string, lang string")
    for rows in (none, none.where("false")):
        model = train_language_model(rows)
        assert [x.lang_pred for x in predict_language(rows, model).collect()] == ["und"] * rows.count()
    one = train_language_model(spark.createDataFrame([(i, "only this", "en") for i in range(9)], "id long, text string, lang string"))
    assert one.languages == ["en"]


def test_temperature_makes_scores_honest():
    random = np.random.default_rng(2)
    labels = random.integers(0, 3, 4000)
    scores = np.eye(3)[np.where(random.random(4000) < 0.8, labels, random.integers(0, 3, 4000))] * 40
    t = temperature_for(scores, labels)
    p = 1 / (1 + 2 * math.exp(-40 / t))
    assert abs(p - (0.8 + 0.2 / 3)) < 0.02


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home, sweet home.</a></li></ul></nav>
<div class="cookie-notice">We use cookies, as all do. Accept them.</div>
<main><article><h1>A &amp; B</h1><p>First   para,&nbsp;with <b>bold</b><i>italic</i> text.<p>Second: a&#228;b &lt;tag&gt;
<ul><li>one<li>two</ul><aside>Not this, never.</aside><form><label>Mail</label><input></form>
<blockquote>Quoted words.</blockquote><script>var x = "</p><p>no</p>";</script><!-- <p>no</p> --><p>Last<br>line.</p></article></main>
<div id="sidebar"><p>Related things, many of them, here.</p></div><section class="comments"><p>I think, therefore, I comment!</p></section>
<div class="ad">Buy now, pay later.</div><footer><p>&copy; someone, somewhere.</p></footer></body></html>"""


def test_main_text():
    assert main_text(PAGE).split("\n") == [
        "A & B", "First para, with bolditalic text.", "Second: aäb <tag>", "one", "two", "Quoted words.", "Last line.",
    ]
    plain = "<div id=content><h2>Title</h2><p>Some text, with commas, and so on.</p><div>More text, as a block.</div></div>"
    assert main_text(f"<body><div class=menu><a>x</a></div>{plain}</body>").split("\n") == [
        "Title", "Some text, with commas, and so on.", "More text, as a block.",
    ]
    assert main_text("just text, no tags") == "just text, no tags"
    for page in (None, "", "<", "<p", "<!-- open", "<script>never closed", "</p></div>", "<a href='x>broken", "&#xFFFFFFFF; &bogus;"):
        assert isinstance(main_text(page), str)
    assert main_text("<p>" * 5000 + "deep, text." + "<div>" * 3000) == "deep, text."


def test_names_inside_the_content_are_one_signal():
    long = "A sentence of the text, with a comma, and more of it."
    page = (
        f"<body><article><h1>Title</h1><p>{long} {long}</p><h2 id='how-to-share-files'>Sharing</h2><p class='form'>{long} {long}</p>"
        f"<section id='legal-history'><p>{long}</p></section><section class='legal'><p>{long} {long}</p></section>"
        f"<div class='social-science'><p>{long}</p></div><h2 id=share>Found</h2><h2 id='search-results'>Results</h2><p>{long}</p>"
        "<div class='share'><a href=x>Tell a friend</a></div><section class=comments><p>I think, therefore, I comment!</p></section></article>"
        f"<div class='site-footer'><p>{long}</p></div></body>"
    )
    assert main_text(page).split("\n") == [
        "Title", f"{long} {long}", "Sharing", f"{long} {long}", long, f"{long} {long}", long, "Found", "Results", long,
    ]


def test_text_in_several_containers_is_whole():
    part = lambda n, k: "".join(f"<p>Sentence {n}.{i}, with a comma, and more.</p>" for i in range(k))
    want = lambda n, k: [f"Sentence {n}.{i}, with a comma, and more." for i in range(k)]
    both = want(1, 13) + want(2, 7)
    assert main_text(f"<body><div id=content><div class=p1>{part(1, 13)}</div><div class=p2>{part(2, 7)}</div></div></body>").split("\n") == both
    assert main_text(f"<body><section>{part(1, 13)}</section><nav><a>x</a></nav><section>{part(2, 7)}</section></body>").split("\n") == both
    page = f"<body><main><article>{part(1, 3)}</article><article>{part(2, 7)}</article></main></body>"
    assert main_text(page).split("\n") == want(1, 3) + want(2, 7)


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", "<p>" + "long, text. " * 50_000, "z")],
        "page_id long, url string, html string, text string",
    )
    got = extract_main_text(pages).collect()
    assert len(got) == 5 and [x.text for x in got if x.id == 2] == [""]
    assert len(next(x for x in got if x.id == 3).text) == 12 * 50_000 - 1
    assert extract_main_text(pages.where("false")).collect() == []


def edf(weights):
    """The cycle slot by slot: of the released blocks the one due first."""
    order = sorted(weights, key=lambda s: (-weights[s], s))
    total, done, cycle = sum(weights.values()), Counter(), []
    for slot in range(total):
        due = [(-(-(done[s] + 1) * total // weights[s]), i, s) for i, s in enumerate(order) if done[s] * total // weights[s] <= slot]
        chosen = min(due)[2]
        cycle.append((chosen, done[chosen], slot))
        done[chosen] += 1
    return cycle


def test_pfair_cycles_stay_within_a_block(spark):
    r = fixtures.random.Random(6)
    for weights in ({"a": 1}, {"a": 5, "b": 3, "c": 2}, {f"s{i}": r.randint(1, 9) for i in range(12)}):
        targets = spark.createDataFrame(list(weights.items()), "source string, weight int")
        got = [tuple(x) for x in pfair_slots(targets).select("source", "block", "slot").orderBy("slot").collect()]
        assert got == edf(weights)
        total, done = sum(weights.values()), Counter()
        for source, _, slot in got:
            done[source] += 1
            assert all(abs(done[s] - weights[s] * (slot + 1) / total) < 1 for s in weights)
    assert pfair_slots(spark.createDataFrame([("a", 0)], "source string, weight int")).collect() == []


def test_mixing_places_every_row(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    targets = spark.createDataFrame([("src0", 3), ("src1", 2), ("src2", 1), ("src3", 0)], "source string, weight int")
    laid = mixed(docs, targets, block_chars=500, keep=("source", "n_chars"))
    got = laid.collect()
    assert len(got) == docs.count() and len({x.id for x in got}) == len(got)
    cycle = {(s, b): slot for s, b, slot in edf({"src0": 3, "src1": 2, "src2": 1})}
    weights = {"src0": 3, "src1": 2, "src2": 1}
    by_source = defaultdict(list)
    for x in got:
        by_source[x.source].append(x)
        if x.source in weights:
            w = weights[x.source]
            assert x.slot == x.block // w * 6 + cycle[x.source, x.block % w]
        else:
            assert x.slot is None
        assert x.block == x.place // 500 and x.kept.source == x.source
    for rows in by_source.values():
        place = 0
        for x in sorted(rows, key=lambda x: x.place):
            assert x.place == place
            place += max(1, x.kept.n_chars)
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "CartesianProduct", "NestedLoop"))


def test_mixing_on_odd_tables(spark):
    docs = fixtures.documents(spark)
    got = mixed(docs, source_targets(docs), block_chars=100).collect()
    assert Counter(x.id for x in got) == Counter(r.doc_id for r in docs.collect())
    assert all(x.slot is not None for x in got) and "" in {x.source for x in got}
    places = Counter((x.source, x.place) for x in got)
    assert max(places.values()) == 1
    assert mixed(fixtures.with_null_ids(spark), source_targets(docs)).count() == 34
    none = fixtures.empty(spark)
    assert mixed(none, source_targets(none)).collect() == []
    with pytest.raises(ValueError):
        mixed(docs, spark.createDataFrame([("src1", 200_000)], "source string, weight int"))


def lm_rows(df):
    return df.select(F.col("doc_id").alias("id"), "text", held_out("doc_id", 10, 0).alias("held"))


def check_base(rows, got):
    split = [brute.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")) for r in rows]
    counts, ends = Counter(), 0
    for r, words in zip(rows, split):
        if not r.held:
            counts.update(words)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    want = Counter()
    for r, words in zip(rows, split):
        c = [counts[w] for w in words] + [ends]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
        want[r.id, len(c), sum(x > 0 for x in c), n, round(base, 4)] += 1
    assert Counter((x.id, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 4)) for x in got) == want


def test_scores_of_texts(spark):
    rows = lm_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = lm.score_texts(rows, top=500, size=16, block_bytes=1 << 20).collect()
    check_base(rows.collect(), got)
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_words_beyond_the_commonest_are_told_by_their_context(spark):
    r = fixtures.random.Random(12)
    common = ["aaa", "bbb", "ccc", "ddd"]
    rare = {w: ["".join(r.choice("efgh") for _ in range(6)) + w for _ in range(300)] for w in common}
    rows = [(i, " ".join(x for w in r.choices(common, k=100) for x in (w, r.choice(rare[w]))), i % 5 == 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string, held boolean")
    got = [x for x in lm.score_texts(docs, top=4, size=8, rounds=3, block_bytes=1 << 14).collect() if x.held_out]
    tokens = sum(x.n_tokens for x in got)
    # half the tokens are rare words, and the word before says which quarter of them
    one_class = [x for x in lm.score_texts(docs, top=4, size=8, rounds=3, block_bytes=1 << 14, classes=1).collect() if x.held_out]
    assert sum(x.score for x in got) > sum(x.score for x in one_class) + 0.08 * tokens


def test_scores_on_odd_tables(spark):
    for docs in (fixtures.documents(spark), fixtures.with_null_ids(spark)):
        rows = lm_rows(docs)
        check_base(rows.collect(), lm.score_texts(rows, top=50, size=4, rounds=1, block_bytes=3000).collect())
    rows = lm_rows(fixtures.documents(spark))
    assert lm.score_texts(rows.where("false")).collect() == []
    untrained = lm.score_texts(rows.limit(20).withColumn("held", F.lit(True)), top=50, size=4, rounds=1).collect()
    assert all(x.n_known == 0 and x.train_tokens == 0 and math.isfinite(x.score) for x in untrained)


def test_model_probabilities_add_up_and_learn():
    random = np.random.default_rng(3)
    n = 30
    follows = random.permutation(n)
    text = [0]
    for _ in range(20_000):
        text.append(int(follows[text[-1]]) if random.random() < 0.8 else int(random.integers(n)))
    text = np.array(text)
    before, word = np.stack([text[1:-1], text[:-2]], axis=1), text[2:]
    counts = np.bincount(word, minlength=n).astype(float)
    model = start = lm.initial(counts, 16)
    for seed in range(4):
        model = lm.train(model, before, word, np.ones(len(word)), lm.noise_of(counts), seed, samples=32)
    every = np.arange(n)
    for b in ([1, 2], [7, 7]):
        p = np.exp(lm.log_probabilities(model, np.tile(b, (n, 1)), every))
        assert abs(p.sum() - 1) < 1e-4
    assert lm.log_probabilities(model, before, word).mean() > lm.log_probabilities(start, before, word).mean() + 1


def test_tabled_scores_equal_the_sums_over_the_vocabulary():
    random = np.random.default_rng(4)
    n, size = 40, 5
    model = lm.Model(random.normal(0, 2, (n, size)), random.normal(0, 2, (n, size)), random.normal(1, 1, (2, size)), random.normal(0, 3, n))
    far = model._replace(context=model.context * 200)  # parts so unlike that their products vanish
    every = np.stack([np.repeat(np.arange(n), n), np.tile(np.arange(n), n)], axis=1)
    word = random.integers(0, n, len(every))
    for m in (model, far):
        scores = lm.predicted(m, every) @ m.target.T + m.bias
        most = scores.max(axis=1)
        plain = scores[np.arange(len(every)), word] - most - np.log(np.exp(scores - most[:, None]).sum(axis=1))
        got = lm.log_probabilities(m, every, word, tables=lm.tables_of(m))
        assert np.allclose(got, plain, rtol=1e-9, atol=1e-6)
    assert lm.tables_of(lm.initial(np.ones(lm.MOST_TABLED + 1), 2)) is None


def test_training_deals_every_row_once_and_keeps_neighbours_of_a_context_together():
    before = np.array([[1, 2]] * 11 + [[1, 3]] + [[0, 0]] * 4 + [[1, 2]] * 2)
    order, group = lm._dealt(before, np.random.default_rng(2))
    assert sorted(order.tolist()) == list(range(len(before)))
    runs = [order[group == k].tolist() for k in range(group[-1] + 1)]
    assert sorted(map(len, runs)) == sorted([4, 4, 3, 1, 4, 2])
    assert all(run == list(range(run[0], run[0] + len(run))) and (before[run] == before[run[0]]).all() for run in runs)
    order, group = lm._dealt(before[:0], np.random.default_rng(2))
    assert len(order) == len(group) == 0


def test_lm_blocks_count_bytes_of_utf8(spark):
    rows = spark.createDataFrame([(i, False, "\u00e4" * 500) for i in range(64)], "id long, held boolean, text string").coalesce(1)
    assert [len(x.ids) for x in lm._packed(rows, 16_000).orderBy("block").collect()] == [16] * 4


def test_pipeline_equals_plain_stages(spark):
    got = corpus_pipeline.run(spark, SMALL)
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert got.columns == [*columns, "slot", "place"]
    rows = got.collect()
    assert [(x.slot, x.place) for x in rows] == sorted((x.slot, x.place) for x in rows)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    # no document of the table lacks a language; all have letters
    stay = [r for r in docs if any(c.isalpha() for c in r.text or "")]
    best = {}
    for r in stay:
        best[r.text] = max(best.get(r.text, r), r, key=lambda x: x.doc_id)
    stay = sorted(best.values(), key=lambda r: r.doc_id)
    sets = {r.doc_id: brute.shingles(r.text) for r in stay}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    least = brute.least_reachable(sets, links)
    stay = [r for r in stay if least[r.doc_id] == r.doc_id]
    bench = [folded(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    grams = [{tuple(b[i : i + 2]) for i in range(len(b) - 1)} for b in bench]
    clean = []
    for r in stay:
        words = folded(r.text)
        own = {tuple(words[i : i + 2]) for i in range(len(words) - 1)}
        near = [b for b, g in zip(bench, grams) if len(b) >= 8 and len(g & own) >= len(g) // 4]
        if not any(word_distance(b, words) <= len(b) // 4 for b in near):
            clean.append(r)
    assert {tuple(x)[:-2] for x in rows} == {tuple(r) for r in clean}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_odd_tables(spark, stage):
    name, apply = stage
    for docs in (fixtures.documents(spark), fixtures.with_null_ids(spark), fixtures.empty(spark)):
        got = apply(spark, docs, SMALL)
        more = ["slot", "place"] if name == "mixing" else []
        assert got.columns == [*(c for c in docs.columns), *more] or name == "mixing"
        before, after = ([tuple(r)[:5] for r in df.collect()] for df in (docs, got.select(*(f"`{c}`" for c in docs.columns[:5]))))
        assert not Counter(after) - Counter(before)
        if name == "mixing":
            assert Counter(after) == Counter(before)


def test_blocks_of_texts_go_to_python_one_by_one(spark, monkeypatch):
    """A task holds one block at a time, however many it has: in the reader (row groups) and in the batches to Python."""
    from pyarrow import RecordBatch, parquet

    from wattframe.operators.staging import BATCH

    docs = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('one two three ', 10) AS text", "id % 10 = 0 AS held")
    seen = []

    def counted(packed, *args, counts=lm.count_words):
        def rows(batches):
            for batch in batches:
                yield RecordBatch.from_pydict({"n": [batch.num_rows]})

        files = [parquet.ParquetFile(f.removeprefix("file:")).metadata for f in packed.inputFiles()]
        seen.append([(f.num_rows, f.num_row_groups) for f in files if f.num_rows])
        seen.append([r.n for r in packed.mapInArrow(rows, "n long").collect()])
        return counts(packed, *args)

    monkeypatch.setattr(lm, "count_words", counted)
    before = spark.conf.get(BATCH)
    assert lm.score_texts(docs, block_bytes=1000).count() == 60
    (groups, batches) = seen
    assert groups == [(8, 8)] and batches == [1] * 8
    assert spark.conf.get(BATCH) == before
