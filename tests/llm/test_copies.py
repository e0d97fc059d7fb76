"""De-duplication operators against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from tests.llm import brute, fixtures
from wattframe.llm.common import components
from wattframe.llm.exact import distinct_texts, exact_duplicates
from wattframe.llm.lines import (
    BITS_APART, _packed, _unpacked, edit_similarities, edit_similarity, normalised, repeated_lines, simhashes, without_lines,
)
from wattframe.llm import lines, ngram_join, suffix
from wattframe.llm.ngram_join import answered_counts, parities, sent_counts, similar_classes, tiers, tiers_of
from wattframe.llm.queries import QUERIES
from wattframe.llm.substring import distinct_pairs, repeated_sequences
from wattframe.llm.suffix import longest_factors, repeated_bytes
from wattframe.operators.staging import FREED, stored


def by_place(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_repeated_sequences_equal_brute_force(spark):
    docs = fixtures.documents(spark)
    rows = docs.collect()
    split = [brute.WORD.findall(r.text or "") for r in rows]
    gone = brute.without_repeats(split, 12)
    want = Counter(
        (r.doc_id, len(w), tuple(brute.spans(g)), " ".join(x for x, y in zip(w, g) if not y))
        for r, w, g in zip(rows, split, gone)
    )
    assert any(any(g) for g in gone)
    for options in ({}, {"block_bytes": 5000, "bucket_windows": 500}):
        got = repeated_sequences(docs, length=12, **options).collect()
        assert Counter((r.id, r.n_words, tuple((s.start, s.end) for s in r.spans), r.kept_text) for r in got) == want


def test_pairs_that_share_one_hash_are_told_apart():
    long = np.array([5, 5, 5, 1, 5], np.uint64)
    short = np.array([2, 1, 2, 9, 1], np.uint32)
    order, begins, classes = distinct_pairs(long, short)
    assert len(begins) == 3 and classes[0] == classes[2] != classes[1] == classes[4]
    assert sorted(order.tolist()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("limit", [4096, 2])
def test_repeated_bytes_equal_brute_force(spark, limit):
    docs = fixtures.documents(spark)
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    gone = brute.without_repeated_bytes(texts, 100)
    want = Counter(
        (r.doc_id, len(t), tuple(brute.spans(g)), bytes(x for x, y in zip(t, g) if not y)) for r, t, g in zip(rows, texts, gone)
    )
    got = repeated_bytes(docs, length=100, block_bytes=20_000, group_bytes=5000, group_limit=limit).collect()
    assert Counter((r.id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept_bytes)) for r in got) == want


@pytest.mark.parametrize("limit", [4096, 2])
def test_the_first_copy_of_bytes_can_stay(spark, limit):
    r = fixtures.random.Random(3)
    passage = " ".join(fixtures.words(r, 80))
    other = [" ".join(fixtures.words(r, 40)) for _ in range(6)]
    docs = spark.createDataFrame([(i, f"{o} {passage}") for i, o in enumerate(other)], "doc_id long, text string")
    got = repeated_bytes(docs, length=100, keep_first=True, block_bytes=700, group_limit=limit).collect()
    assert sum(passage.encode() in bytes(g.kept_bytes) for g in got) == 1
    assert sorted(len(g.spans) for g in got) == [0, 1, 1, 1, 1, 1]


def test_longest_factors_equal_brute_force():
    random = np.random.default_rng(1)
    data = np.concatenate([random.integers(0, 3, 300), np.tile(random.integers(0, 3, 40), 4)]).astype(np.uint8)
    raw = data.tobytes()
    for depth in (8, 13, 20, 40):
        earlier, later = longest_factors(data, depth)
        for i in range(len(raw) - depth + 1):
            own = raw[i : i + depth]
            assert earlier[i] == (raw.find(own) < i)
            assert later[i] == (raw.rfind(own) > i)


def test_longest_factors_are_read_off_the_suffix_order(monkeypatch):
    data = np.frombuffer(b"abcdefghabcdefghxabcdefgh", np.uint8)
    order, rank = suffix.suffix_ranks(data, 8)
    monkeypatch.setattr(suffix, "suffix_ranks", lambda data, depth: (order, rank))
    monkeypatch.setattr(suffix, "previous_smaller", None, raising=False)  # no search beyond the neighbours
    earlier, later = longest_factors(data, 8)
    assert np.flatnonzero(earlier).tolist() == [8, 17] and np.flatnonzero(later).tolist() == [0, 8]


def test_similar_classes_equal_brute_force(spark):
    docs = fixtures.documents(spark)
    rows = docs.collect()
    sets = [brute.shingles(r.text) for r in rows]
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    least = brute.least_reachable(range(len(rows)), links)
    smallest = {}
    for i, r in enumerate(rows):
        smallest[least[i]] = min(smallest.get(least[i], r.doc_id), r.doc_id)
    want = Counter((r.doc_id, len(sets[i]), smallest[least[i]]) for i, r in enumerate(rows))
    assert by_place(similar_classes(docs), ["id", "n_shingles", "component_id"]) == want


def test_ngram_counts_over_blocks():
    random = np.random.default_rng(1)
    sets = [np.unique(random.integers(0, 400, 60).astype(np.uint64) << np.uint64(55)) for _ in range(9)]
    blocks = [(np.concatenate(sets[k:k + 3]), np.cumsum([0] + [len(s) for s in sets[k:k + 3]])) for k in (0, 3, 6)]
    sent = pa.concat_tables([sent_counts(b, *block, 4) for b, block in enumerate(blocks)])
    parts = [sent.filter(pa.compute.equal(sent["bucket"], k)) for k in range(4)]
    answers = pa.concat_tables([answered_counts(part) for part in parts])
    held = Counter(int(g) for s in sets for g in s)
    for b, (hashes, _) in enumerate(blocks):
        got = tiers_of(hashes, answers.filter(pa.compute.equal(answers["block"], b)), 4)
        assert got.tolist() == [held[int(g)] - 1 for g in hashes]
    counts = tiers(np.arange(1, 100000)).astype(int)
    assert (np.diff(counts) >= 0).all() and counts[:31].tolist() == list(range(31))


def test_parities_never_exceed_the_difference():
    random = np.random.default_rng(2)
    draw = lambda n: np.unique(random.integers(0, 1 << 63, n).astype(np.uint64))
    common = draw(300)
    sets = [np.union1d(common, draw(k)) for k in (0, 1, 5, 40, 900)] + [common[:0]]
    odd = parities(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]))
    for a, x in zip(sets, odd):
        for b, y in zip(sets, odd):
            differ = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
            assert differ <= len(np.setxor1d(a, b))


def test_pairs_meet_only_where_they_can_share_their_first_gram(spark):
    # sets of 100: 86 must be common, so the first common n-gram is among the first 15
    shared = {(1, 2): range(20, 26), (3, 4): range(10, 26), (5, 6): range(15, 26), (7, 8): range(14, 26)}
    rows = [
        (100 * a + pos if pos in common else 100 * node + pos + 10_000, node, 100, pos, [0] * 8)
        for (a, b), common in shared.items() for node in (a, b) for pos in range(26)
    ]
    entries = spark.createDataFrame(rows, "h long, node long, size long, pos int, odd array<long>")
    component = spark.createDataFrame([(k, k) for k in range(1, 9)], "node long, component long")
    assert by_place(ngram_join._cross_pairs(entries, component, 75), ["a", "b"]) == Counter([(3, 4), (7, 8)])


def test_later_links_merge_the_components_found_before(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ngram_join, "components", lambda edges: seen.append(edges.collect()) or components(edges))
    component = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6)], "node long, component long")
    links = spark.createDataFrame([(2, 4), (1, 3), (4, 5)], "a long, b long")
    assert by_place(ngram_join._merged(component, links), ["node", "component"]) == Counter(
        {(1, 1): 1, (2, 1): 1, (3, 1): 1, (4, 1): 1, (5, 1): 1, (6, 6): 1}
    )
    assert {tuple(r) for r in seen[0]} == {(1, 3), (3, 5)}


def test_null_ids_in_similar_classes(spark):
    got = similar_classes(fixtures.with_null_ids(spark)).collect()
    assert len(got) == 34
    assert sum(r.id is None for r in got) == 4


def test_components(spark):
    random = fixtures.random.Random(2)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, i) for i in range(501, 560)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    want = brute.least_reachable(nodes, links)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(nodes)


def exact_want(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    return Counter(
        (
            r.doc_id, max((i for i in groups[r.text or ""] if i is not None), default=None), len(groups[r.text or ""]),
            r.doc_id == max((i for i in groups[r.text or ""] if i is not None), default=None),
            hashlib.sha256((r.text or "").encode()).hexdigest(),
        )
        for r in rows
    )


@pytest.mark.parametrize("digest", [None, "substring(sha2(text, 256), 1, 1)", "'same'"])
def test_exact_duplicates_equal_brute_force_even_if_digests_collide(spark, digest):
    columns = ["id", "keep_id", "group_size", "kept", "text_sha256"]
    for docs in (fixtures.documents(spark), fixtures.with_null_ids(spark)):
        got = exact_duplicates(docs, salts=3, digest=F.expr(digest) if digest else None)
        assert by_place(got, columns) == exact_want(docs.collect())


def test_distinct_texts_keep_whole_rows(spark):
    docs = fixtures.documents(spark)
    got = distinct_texts(docs)
    assert got.columns == docs.columns
    rows = [tuple(r) for r in docs.collect()]
    kept = [tuple(r) for r in got.collect()]
    assert set(kept) <= set(rows) and len(kept) == len({r[1] or "" for r in rows})
    best = {}
    for r in rows:
        best[r[1] or ""] = max(best.get(r[1] or "", -1), r[0])
    assert {r[1] or "": r[0] for r in kept} == best


def test_no_exact_operator_leaves_the_jvm(spark):
    docs = fixtures.documents(spark)
    for df in (exact_duplicates(docs), distinct_texts(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def line_groups(rows, similarity, min_bytes):
    places = {}
    for doc, text in rows:
        for n, line in enumerate((text or "").encode().split(b"\n")):
            line = normalised(line)
            if len(line) >= min_bytes:
                places.setdefault(line, []).append((doc, n))
    lines = sorted(places)
    hashes = dict(zip(lines, simhashes(lines).tolist()))
    by_hash = {}
    for line in lines:
        by_hash.setdefault(hashes[line], []).append(line)
    assert all(len(v) == 1 for v in by_hash.values())
    links = [
        (a, b) for a in lines for b in lines
        if a < b and bin(hashes[a] ^ hashes[b]).count("1") <= BITS_APART and edit_similarity(a, b, similarity)
    ]
    least = brute.least_reachable(lines, links)
    first = {}
    for line in lines:
        first[least[line]] = min(first.get(least[line], min(places[line])), min(places[line]))
    gone = {}
    for line in lines:
        for doc, n in places[line]:
            if (doc, n) != first[least[line]]:
                gone.setdefault(doc, set()).add(n)
    return gone, len(links)


def test_repeated_lines_equal_brute_force(spark):
    r = fixtures.random.Random(9)
    stock = [" ".join(fixtures.words(r, 40)) for _ in range(12)]
    near = [s[:60] + "q" + s[61:] for s in stock]
    rows = []
    for i in range(40):
        own = r.sample(stock, 2) + r.sample(near, 2) + [" ".join(fixtures.words(r, 10)), "short", "", f"Page {i} of the whole book, chapter {i}"]
        r.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x\r\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone, links = line_groups(rows, 0.8, 16)
    assert links and gone
    found = repeated_lines(docs)
    got = {x.id: x for x in found.collect()}
    assert {i: set(x.removed) for i, x in got.items() if x.removed} == gone
    assert got[100].n_lines == 1 and got[102].n_lines == 3
    kept = {x.doc_id: x.text for x in without_lines(docs, found).collect()}
    for i, text in rows:
        lines = None if text is None else [x for n, x in enumerate(text.split("\n")) if n not in gone.get(i, ())]
        assert kept[i] == (None if lines is None else "\n".join(lines))


def test_lines_meet_by_edit_similarity_alone(spark):
    r = fixtures.random.Random(5)
    rows, pairs = [], []
    for size in (5, 8, 15, 30, 80) * 30:
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(size)]
        line, near = " ".join(words), words[:]
        near[r.randrange(size)] = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
        if r.random() < 0.5 and size > 15:
            near[r.randrange(size)] = "other"
        near = " ".join(near)
        if near != line and edit_similarity(line.encode(), near.encode(), 0.8):
            pairs.append((2 * len(pairs) + 1, size))
            rows += [(pairs[-1][0] - 1, line), (pairs[-1][0], near)]
    found = {x.id for x in repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.removed}
    for size in (5, 8, 15, 30, 80):
        own = [i for i, n in pairs if n == size]
        assert len(own) >= 25 and len(found & set(own)) >= 0.9 * len(own)


def test_query_takes_short_repeats_out(spark, tmp_path):
    rows = [(1, "ab\nPage 3 of 40\n\n7"), (2, "Page 12 of 40\nAB!\n\nxyz"), (3, "8\nown\nletzte."), (4, "Ietzte.\nxyw")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.removed_lines for x in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 1], 3: [0], 4: [0]}


def test_edit_similarity_equals_the_full_table():
    r = fixtures.random.Random(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(300):
        a = bytes(r.choice(b"abc") for _ in range(r.randint(1, 25)))
        b = bytes(r.choice(b"abc") if r.random() < 0.2 else x for x in a)[r.randint(0, 2) :] + b"c" * r.randint(0, 3)
        if b:
            for least in (0.5, 0.8, 1.0):
                assert edit_similarity(a, b, least) == (1 - distance(a, b) / max(len(a), len(b)) >= least - 1e-12)


@pytest.mark.parametrize("operator", [repeated_sequences, repeated_bytes, similar_classes, exact_duplicates, distinct_texts, repeated_lines])
def test_odd_tables(spark, operator):
    assert operator(fixtures.empty(spark)).collect() == []
    got = operator(fixtures.with_null_ids(spark))
    assert operator is distinct_texts or got.count() == 34
    nothing = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert operator(nothing).count() == (1 if operator is distinct_texts else 2)


def test_bucket_entries_travel_in_eleven_bytes():
    random = np.random.default_rng(6)
    places = np.sort(random.integers(0, 1 << 32, 2000).astype(np.uint64)) | np.uint64(5 << 32)
    line = random.integers(0, 1 << 63, 2000).astype(np.uint64)
    packed = _packed(places, line)
    assert len(pa.compress(packed, codec="lz4", asbytes=True)) < 11.2 * 2000
    bucket, back = _unpacked(packed)
    assert (bucket | np.uint64(5 << 32) == places).all() and (back == line).all()
    assert [len(x) for x in _unpacked(_packed(places[:0], line[:0]))] == [0, 0]


def test_edit_similarities_side_by_side_equal_those_one_by_one():
    random = np.random.default_rng(7)
    xs, ys = [b"", b"", b"a"], [b"", b"abc", b"a"]
    for size in [1, 5, 63, 64, 65, 128, 129, 200, 1100] * 40:
        x = random.choice(list(b"abcd "), size).astype(np.uint8)
        y = x.copy()
        for _ in range(random.integers(0, size // 3 + 2)):
            place, kind = random.integers(0, len(y) + 1), random.integers(0, 3)
            y = np.insert(y, place, 122) if kind == 0 else np.delete(y, min(place, len(y) - 1)) if len(y) > 1 and kind == 1 else y
            y[min(place, len(y) - 1)] = random.integers(97, 101)
        xs.append(x.tobytes())
        ys.append(y.tobytes())
    for least in (0.8, 0.95):
        plain = [edit_similarity(x, y, least) for x, y in zip(xs, ys)]
        assert edit_similarities(xs, ys, least).tolist() == plain and 0 < sum(plain) < len(plain)


def test_freed_shuffles_leave_no_files(spark):
    """The entries of all lines are gone from the disk before the texts of the lines wanted are moved."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(manager.getAllBlocks().apply(i).name().endswith(".data") for i in range(manager.getAllBlocks().size()))
    setting, rows = spark.conf.get(FREED, None), spark.range(1000).repartition(3, F.col("id") % 7)
    before = files()
    found = stored(rows, "freed", free=True)
    assert files() <= before and spark.conf.get(FREED, None) == setting
    assert found.count() == 1000


def test_repeated_lines_compare_pairs_in_passes_and_leave_little(spark, monkeypatch, tmp_path):
    """Many passes find what one finds; pairs, texts and buckets are gone from the disk when the result is read."""
    random = np.random.default_rng(3)
    words = ["".join(random.choice(list("abcdefgh"), 5)) for _ in range(60)]
    heads = [" ".join(random.choice(words, 12)) for _ in range(6)]
    texts = ["\n".join(f"{heads[k % 6]} {' '.join(random.choice(words, n))}" for n in (1, 4, 12)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr("wattframe.operators.staging.shared_folder", lambda spark: str(tmp_path))
    found = lambda: {r.id: r.removed for r in repeated_lines(docs).collect()}
    one = found()
    assert any(one.values())
    names = []
    monkeypatch.setattr(lines, "stored", lambda df, name, free=False: names.append(name) or stored(df, name, free))
    monkeypatch.setattr(lines, "PASS_BYTES", 20000)
    monkeypatch.setattr(lines, "PASS_SHARE", 0.01)
    assert found() == one
    assert names.count("lines-links") > 2  # one for each kind of pair, unless there are passes
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert left == {"lines", "lines-distinct", "lines-links", "links"}
