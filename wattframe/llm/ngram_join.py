"""Self-join of texts on the Jaccard similarity of their word n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stored
from .common import components, in_blocks, lists, rolling_hashes, split_words, strong_hashes, texts_of, word_ids
from .substring import _packed, _unpacked, bucket_edges

#: N-grams are counted and indexed by the upper six bytes of their hashes; links are verified on all eight.
UPPER = np.uint64(0xFFFFFFFFFFFF0000)
#: Bits of a set's parity signature, a multiple of 64.
PARITY_BITS = 512
BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 2 << 20


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and the text of each.

    Words are runs of other than ASCII white space, with A-Z lowered.  A text of fewer words has one n-gram, all of it.
    """
    words = split_words(texts, lower=True)
    ids, distinct = word_ids(words)
    values = strong_hashes(distinct.to_pylist())[:, 0][ids]
    counts, owners = np.diff(words.first), words.text_of
    parts, texts_of_parts = [], []
    full = rolling_hashes(values, n, BASE)
    inside = owners[: len(full)] == owners[n - 1 :][: len(full)]
    parts.append(full[inside])
    texts_of_parts.append(owners[: len(full)][inside])
    for short in range(1, n):
        of = np.flatnonzero(counts == short)
        if len(of):
            parts.append(rolling_hashes(values, short, BASE)[words.first[of]] + np.uint64(short))
            texts_of_parts.append(of)
    hashes, owner = np.concatenate(parts), np.concatenate(texts_of_parts)
    return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), owner


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct n-gram hashes of each text, one after the other, and where each text's begin."""
    hashes, owner = shingles(texts, n)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])[: len(hashes)]
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batches, cut to about ``SLICE_BYTES`` of text, and their texts; a single text is never cut."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
        edge = np.cumsum([0] + [len(t) for t in texts])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(at, to - at), texts[at:to]
            at = to


def block_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of a whole block, made slice by slice."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    edge = np.cumsum([0] + [len(t) for t in texts])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + SLICE_BYTES, "right")) - 1)
        hashes, first = shingle_sets(texts[at:to], n)
        parts.append(hashes)
        sizes.append(np.diff(first))
        at = to
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def sent_counts(block: int, hashes: np.ndarray, first: np.ndarray, buckets: int) -> pa.Table:
    """One row per bucket with the distinct n-grams of a block in its range, and in how many different sets each is."""
    seen = set()
    own = [hashes[:0]]
    for lo, hi in zip(first[:-1], first[1:]):
        digest = xxhash.xxh3_128_digest(hashes[lo:hi].tobytes())
        if digest not in seen:
            seen.add(digest)
            own.append(hashes[lo:hi])
    keys, counts = np.unique(np.concatenate(own) & UPPER, return_counts=True)
    edges = bucket_edges(keys, buckets)
    full = np.flatnonzero(np.diff(edges))
    counts = counts.astype(np.uint32)
    return pa.table({
        "bucket": pa.array(full, pa.int64()),
        "block": pa.array(np.full(len(full), block), pa.int64()),
        "payload": pa.array(
            [_packed(keys[edges[k]:edges[k + 1]], counts[edges[k]:edges[k + 1]]) for k in full], pa.binary()
        ),
    })


def tiers(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte that keeps their order: exact below 32, then eight steps a doubling; 0 for a single set."""
    steps = np.floor(8 * np.log2(np.maximum(counts, 1)) - 9)
    return np.minimum(np.where(counts < 32, counts - 1, steps), 255).astype(np.uint8)


def answered_counts(bucket: pa.Table) -> pa.Table:
    """For all that was sent to one bucket the tier of each n-gram, by its count over all blocks."""
    bucket = bucket.sort_by("block")
    sent = [_unpacked(p) for p in bucket["payload"].to_pylist()]
    keys, counts = (np.concatenate([s[k] for s in sent]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    del keys
    totals = tiers(np.add.reduceat(counts[order], np.flatnonzero(new), dtype=np.int64))
    tier = np.empty(len(order), np.uint8)
    tier[order] = totals[np.cumsum(new, dtype=np.int32) - 1]
    edges = np.cumsum([0] + [len(s[0]) for s in sent])
    found = [tier[lo:hi].tobytes() for lo, hi in zip(edges[:-1], edges[1:])]
    return pa.table({"bucket": bucket["bucket"], "block": bucket["block"], "tiers": pa.array(found, pa.binary())})


def tiers_of(hashes: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """The tier of every n-gram of a block, from the answers to what it sent."""
    keys, classes = np.unique(hashes & UPPER, return_inverse=True)
    edges = bucket_edges(keys, buckets)
    tier = np.zeros(len(keys), np.uint8)
    for bucket, found in zip(answers["bucket"].to_pylist(), answers["tiers"].to_pylist()):
        tier[edges[bucket]:edges[bucket + 1]] = np.frombuffer(found, np.uint8)
    return tier[classes]


def parities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set ``PARITY_BITS`` bits, as longs: whether the number of its n-grams in a class of hashes is odd.

    An n-gram that only one of two sets has flips one bit, so the bits that differ never outnumber such n-grams.
    """
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = owner * PARITY_BITS + ((hashes >> np.uint64(20)) % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = np.bincount(place, minlength=(len(first) - 1) * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, PARITY_BITS), axis=1).view(np.int64)


def required(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of sets of sizes ``a`` and ``b`` with 100 * intersection >= percent * union."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9)).cast("long")


def similar_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75,
    block_bytes: int = 8 << 20, bucket_grams: int = 1 << 21,
) -> DataFrame:
    """For every row: ``id``, ``n_shingles`` and ``component_id``, the least id that links lead to; also
    ``tx``, xxhash64 of its text, and ``group``, a number of its component (null without words).

    Two texts link when 100 * (common n-grams) >= percent * (n-grams of either).  Texts with the same
    set form a class and go on as one.  N-grams are ranked rare first by the number of sets that hold them (any order
    that all texts share gives the same links): blocks of texts send each distinct n-gram once, packed, to the
    bucket of its range, with its count in the block, and get back one byte for each, its rank by the total.
    A class is indexed by its prefix, the n-grams of which a linked class must share at least one; those
    that no other set holds need no entry.  Candidates pass the length and positional filters on the prefix and the
    suffix filter, first by parities (see ``parities``) where they meet, then by the counts of two sets in
    equal ranges of the hash, which bound what they can share; each pair is verified once, on the whole sets.

    Links are looked for only where they can still join two components.  First every class meets two
    pivots in each of its prefix n-grams, so a group of copies costs two rows an n-gram and not a row a pair.
    Then, in the n-grams whose classes still lie in different components, the classes outside the largest meet one
    class of it, another one each turn, as long as a tenth of these pairs are links.  What still lies apart
    is decided whole: all pairs across components are candidates, formed between the classes outside the
    n-gram's largest component and all others, each where it can be the first n-gram that they share.  No link that
    joins components is lost.  Links found later merge the components found before.

    A text that is null or has no word has size 0, links with nothing and is its own component.  A row
    with a null id can link rows, and its component is the least id among the others, null if there is none.
    """
    keyed = texts_of(docs, id_col, text_col).withColumn("tx", F.xxhash64("text"))
    blocks, total = in_blocks(keyed, block_bytes)
    buckets = int(total // 6 // bucket_grams) + 1

    def sets_of(block: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        block = block.sort_by("row")
        return block, *block_sets([t or b"" for t in block["text"].cast(pa.binary()).to_pylist()], n)

    def send(block: pa.Table) -> pa.Table:
        block, hashes, first = sets_of(block)
        return sent_counts(block["block"][0].as_py(), hashes, first, buckets)

    def describe(block: pa.Table, answers: pa.Table) -> pa.Table:
        block, hashes, first = sets_of(block)
        tier = tiers_of(hashes, answers, buckets)
        digests, prefixes, skipped, bands = [], [], [], []
        for lo, hi in zip(first[:-1], first[1:]):
            own, size = hashes[lo:hi], hi - lo
            head = size - (size * percent + 99) // 100 + 1 if size else 0
            order = np.argsort(tier[lo:hi], kind="stable")[:head]
            alone = int(np.count_nonzero(tier[lo:hi][order] == 0))
            digests.append(xxhash.xxh3_128_digest(own.tobytes()))
            prefixes.append(_short(own[order[alone:]]))
            skipped.append(alone)
            bands.append(_bands(own))
        odd = parities(hashes, first)
        return pa.table({
            "id": block["id"], "tx": block["tx"], "row": block["row"],
            "size": pa.array(np.diff(first), pa.int64()),
            "digest": pa.array(digests, pa.binary()),
            "prefix": pa.array(prefixes, pa.binary()),
            "skipped": pa.array(skipped, pa.int32()),
            "bands": pa.array(bands, pa.binary()),
            "odd": lists(pa.array(odd.reshape(-1), pa.int64()), np.full(len(odd), PARITY_BITS // 64)),
        })

    id_type = blocks.schema["id"].dataType.simpleString()
    grouped = blocks.groupBy("block")
    answers = grouped.applyInArrow(send, "bucket long, block long, payload binary").groupBy("bucket").applyInArrow(
        answered_counts, "bucket long, block long, tiers binary"
    )
    described = stored(grouped.cogroup(answers.groupBy("block")).applyInArrow(
        describe,
        f"id {id_type}, tx long, row long, size long, digest binary, prefix binary, skipped int, bands binary, odd array<long>",
    ), "ngram-sets")
    filled = described.where("size > 0")
    classes = filled.groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("least"))
    members = stored(filled.select("row", "digest").join(classes, "digest").select("row", "node", "least"), "ngram-classes")
    shape = filled.select(F.col("row").alias("node"), "size", "bands", "id", "tx")

    heads = members.where("row = node").select("row")
    entries = filled.select("row", "size", "prefix", "skipped", "odd").join(heads, "row", "left_semi").mapInArrow(
        _entries, "h long, node long, size long, pos int, odd array<long>"
    )
    entries = stored(entries, "ngram-entries")

    nodes = members.select("node").distinct()
    def verified(pairs: DataFrame) -> DataFrame:
        near = stored(_near(pairs, shape, percent), "ngram-pairs")
        return stored(_verified(near, keyed, shape, n, percent), "ngram-links")

    component = _labelled(nodes, verified(_star_pairs(entries, percent)).where("linked"))
    for turn in count():
        tried = verified(_bridge_pairs(entries, component, percent, turn))
        pairs, found = tried.agg(F.count("*"), F.count_if("linked")).first()
        if found:
            component = _merged(component, tried.where("linked"))
        if 10 * found <= pairs:
            break
    last = verified(_cross_pairs(entries, component, percent)).where("linked")
    if not last.isEmpty():
        component = _merged(component, last)
    labelled = members.join(component, "node")
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    label = labelled.join(smallest, "component").select("row", "component_id", "component")
    return filled.select("row", "id", "size", "tx").join(label, "row").select(
        "id", F.col("size").alias("n_shingles"), "component_id", "tx", F.col("component").alias("group")
    ).union(described.where("size = 0").select("id", "size", "id", "tx", F.lit(None).cast("long")))


def _short(hashes: np.ndarray) -> bytes:
    """The upper six bytes of each hash."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _entries(batches):
    for batch in batches:
        prefixes = batch.column("prefix").to_pylist()
        lengths = np.array([len(p) // 6 for p in prefixes], np.int64)
        wide = np.zeros((lengths.sum(), 8), np.uint8)
        wide[:, 2:] = np.frombuffer(b"".join(prefixes), np.uint8).reshape(-1, 6)
        of = np.repeat(np.arange(len(prefixes)), lengths)
        starts = np.cumsum(lengths) - lengths - batch.column("skipped").to_numpy()
        yield pa.RecordBatch.from_pydict({
            "h": pa.array(wide.reshape(-1).view(np.int64), pa.int64()),
            "node": pa.array(batch.column("row").to_numpy()[of], pa.int64()),
            "size": pa.array(batch.column("size").to_numpy()[of], pa.int64()),
            "pos": pa.array(np.arange(len(of)) - starts[of], pa.int32()),
            "odd": batch.column("odd").take(pa.array(of)),
        })


def _bands(own: np.ndarray) -> bytes:
    """How many hashes lie in each of 2**k equal ranges, k the least with as many ranges as hashes; 255 stands for more."""
    k = max(0, len(own) - 1).bit_length()
    band = (own >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(own), np.int64)
    return np.minimum(np.bincount(band, minlength=1 << k), 255).astype(np.uint8).tobytes()


def _most_common(x: bytes, y: bytes) -> float:
    """At most so many hashes are common to two sets with these bands."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int32) for v in sorted((x, y), key=len))
    least = np.minimum(x, y.reshape(len(x), -1).sum(axis=1))
    return np.inf if (x == 255).any() or (y == 255).any() else least.sum()


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = nodes.join(components(links.select("a", "b")), "node", "left")
    return stored(found.select("node", F.coalesce("component", "node").alias("component")), "ngram-components")


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """``component`` after more links: only the components that these join are labelled anew, not all classes."""
    ends = links.select("a", "b").join(component.toDF("a", "x"), "a").join(component.toDF("b", "y"), "b")
    moved = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("component", "least")
    found = component.join(moved, "component", "left")
    return stored(found.select("node", F.coalesce("least", "component").alias("component")), "ngram-components")


def _passing(met: DataFrame, percent: int, first: bool = False) -> DataFrame:
    """Distinct pairs ``a < b`` of the rows that pass the length, the positional and the parity filter.

    With ``first`` a row passes only as the first common n-gram of a pair that links: no set may have anything in
    common before it.  That loses no link where all pairs of an n-gram meet, as one row of a pair is its first.
    """
    need = required(F.col("size"), F.col("size2"), percent)
    apart = sum(F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("odd2")[i])) for i in range(PARITY_BITS // 64))
    before = F.lit(0) if first else F.least("pos", "pos2")
    return met.where(
        (F.least("size", "size2") >= need)
        & (F.least(F.col("size") - F.col("pos"), F.col("size2") - F.col("pos2")) >= need - before)
        & (apart <= F.col("size") + F.col("size2") - 2 * need)
    ).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each class with two classes of each of its prefix n-grams: the first under an order that all n-grams share, so that
    copies meet the same one, and the first under an order of the n-gram's own, so that they meet many others."""
    columns = ("node", "size", "pos", "odd")
    pivot = lambda *by: F.min_by(F.struct(*columns), F.xxhash64(*by))
    pivots = entries.groupBy("h").agg(
        pivot("node").alias("one"), pivot("node", "h").alias("two"), F.count("*").alias("k")
    ).where("k > 1")
    both = pivots.select("h", F.explode(F.array_distinct(F.array(*(
        F.struct(*(F.col(f"{p}.{c}").alias(f"{c}2") for c in columns)) for p in ("one", "two")
    )))).alias("p")).select("h", "p.*")
    return _passing(entries.join(both, "h").where("node <> node2"), percent)


def _open(entries: DataFrame, component: DataFrame) -> DataFrame:
    """The entries, with their components, of the n-grams that lie in several; ``largest`` is the n-gram's largest one."""
    labelled = entries.join(component, "node")
    parts = labelled.groupBy("h", "component").agg(F.count("*").alias("k"))
    largest = parts.groupBy("h").agg(
        F.max(F.struct("k", "component")).getField("component").alias("largest"), F.count("*").alias("parts")
    ).where("parts > 1").drop("parts")
    return labelled.join(largest, "h")


def _bridge_pairs(entries: DataFrame, component: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each class outside an n-gram's largest component with one class of it, another one each turn."""
    open_ = _open(entries, component)
    columns = ("node", "size", "pos", "odd")
    pivots = open_.where("component = largest").groupBy("h").agg(
        F.min_by(F.struct(*(F.col(c).alias(f"{c}2") for c in columns)), F.xxhash64("node", "h", F.lit(turn))).alias("p")
    ).select("h", "p.*")
    return _passing(open_.where("component <> largest").join(pivots, "h"), percent)


def _cross_pairs(entries: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """All pairs across components in the n-grams that lie in several: the classes outside the largest with all others."""
    open_ = _open(entries, component)
    columns = ("node", "size", "pos", "odd", "component")
    outside = open_.where("component <> largest").select("h", *(F.col(c).alias(f"{c}2") for c in columns))
    met = open_.join(outside, "h").where("component <> component2 AND (component = largest OR node < node2)")
    return _passing(met, percent, first=True)


def _near(pairs: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the suffix filter."""
    shape = shape.select("node", "size", "bands")
    full = pairs.join(shape.toDF("a", "size_a", "bands_a"), "a").join(shape.toDF("b", "size_b", "bands_b"), "b")

    def keep(batches):
        for batch in batches:
            x, y, n = (batch.column(c).to_pylist() for c in ("bands_a", "bands_b", "need"))
            good = pa.array([_most_common(i, j) >= k for i, j, k in zip(x, y, n)], pa.bool_())
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(good) for c in ("a", "b")})

    need = required(F.col("size_a"), F.col("size_b"), percent).alias("need")
    return full.select("a", "b", "bands_a", "bands_b", need).mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, keyed: DataFrame, shape: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b, linked`` by the whole sets of each pair, which are made again from the texts of these classes alone."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stored(shape.join(nodes, "node").select("node", "id", "tx"), "ngram-wanted")
    texts = keyed.alias("t").join(
        wanted.alias("w"), F.col("t.id").eqNullSafe(F.col("w.id")) & F.col("t.tx").eqNullSafe(F.col("w.tx"))
    ).select("w.node", "t.text")

    def build(batches):
        done = set()  # rows equal in id and text meet in one task
        for batch, part in sliced(batches, "text"):
            of = batch.column("node").to_pylist()
            new = [i for i, node in enumerate(of) if not (node in done or done.add(node))]
            hashes, first = shingle_sets([part[i] for i in new], n)
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([of[i] for i in new], pa.int64()),
                "grams": pa.array([hashes[lo:hi].tobytes() for lo, hi in zip(first[:-1], first[1:])], pa.binary()),
            })

    def verify(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_pydict(
                {"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_())}
            )

    sets = stored(texts.mapInArrow(build, "node long, grams binary"), "ngram-texts")
    full = pairs.join(sets.toDF("a", "grams_a"), "a").join(sets.toDF("b", "grams_b"), "b")
    return full.mapInArrow(verify, "a long, b long, linked boolean").distinct()
