"""Removal of byte strings that occur more than once, by longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import covered, in_blocks, lists, rolling_hashes, runs, texts_of
from .substring import answers_to, bucket_edges, seen_hashes, sent_hashes

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Length of the byte strings whose least hash anchors a window; at most half of the shortest match.
GRAM = 32
#: No byte of UTF-8 text.
STOP = 0xFF
PART_BYTES = 1 << 20


# ---- suffix order and longest factors ------------------------------------------------


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``data`` by the first ``depth`` (>= 8) bytes, and the rank of each place.

    Places whose next ``depth`` bytes agree share a rank, the least of their class, and stand in order of place.
    Prefix doubling: ranks by 8 bytes, then by 16, and so on, the last step overlapping the one before
    it; places that are alone in their class are settled and not sorted again.
    """
    n = len(data)
    padded = np.concatenate([data, np.full(8, STOP, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key <<= np.uint64(8)
        key |= padded[k : k + n]
    order = np.argsort(key, kind="stable").astype(np.int32)
    slots = np.arange(n, dtype=np.int32)
    rank = np.full(n + depth, n, np.int32)  # past the end
    rank[order] = _first_slots(key[order], slots)
    length = 8
    while length < depth:
        step = min(length, depth - length)
        by_slot = rank[order]
        slots = np.flatnonzero((by_slot != np.arange(n)) | (np.append(by_slot[1:], n) != np.arange(1, n + 1)))
        if not len(slots):
            break
        place = order[slots]
        key = (rank[place].astype(np.uint64) << np.uint64(32)) | rank[place + step].astype(np.uint64)
        sort = np.argsort(key, kind="stable")
        order[slots] = place = place[sort]
        rank[place] = _first_slots(key[sort], slots)
        length += step
    return order, rank[:n]


def _first_slots(key: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """For ascending keys at ascending slots the first slot of each key."""
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    return np.maximum.accumulate(np.where(new, slots, 0))


def longest_factors(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places begin a factor of ``depth`` bytes that stands at an earlier place, and which at a later one.

    The longest previous factor of a place is the longer of the two that it shares with the previous
    and the next smaller place in suffix order; later ones are found with the signs changed.  Both are
    cut at ``depth``, so that only ``depth`` bytes have to be ordered.  Then places that agree in them stand side by side
    in order of place: the one before in suffix order is the previous smaller place if it agrees, and if
    it does not, no smaller place does; so the neighbours tell both factors.
    """
    order, rank = suffix_ranks(data, depth)
    classes = rank[order]
    same = classes[1:] == classes[:-1]
    earlier, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    earlier[order[1:]], later[order[:-1]] = same, same
    return earlier, later


# ---- anchors -------------------------------------------------------------------------


def anchors(texts: list[bytes], length: int):
    """The anchored windows of some texts: data, text edges, and for each anchor its hash, place, first start, past-the-last start.

    A window is ``length`` bytes of one text; its anchor is the leftmost of its least GRAM hashes, so
    equal windows have equal anchors at the same offset.  The starts that share an anchor are consecutive.
    """
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    sizes = np.diff(edges) - 1
    starts = [np.arange(e, e + s - length + 1) for e, s in zip(edges, sizes) if s >= length]
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    found = [_least_grams(data, part, length) for part in _parts(starts)]
    if not found:
        empty = np.zeros(0, np.int64)
        return data, edges, empty.astype(np.uint64), empty, empty, empty
    least, hashes = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(starts) != 1)]))
    last = np.append(new[1:], len(least)) - 1
    return data, edges, hashes[new], least[new], starts[new], starts[last] + 1


def _parts(starts: np.ndarray):
    """Ascending starts in parts that span at most PART_BYTES, so that a text of any length takes bounded memory."""
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(starts, starts[at] + PART_BYTES))
        yield starts[at:to]
        at = to


def _least_grams(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the leftmost least GRAM hash within each window."""
    lo, width = starts[0], length - GRAM + 1
    part = data[lo : starts[-1] + length]
    values = (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    grams = rolling_hashes(values ^ (values >> np.uint64(32)), GRAM, BASES[0])
    grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    at = np.uint64(len(grams).bit_length())
    key = ((grams >> at) << at) | np.arange(len(grams), dtype=np.uint64)
    padded = np.concatenate([key, np.full(-len(key) % width + width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    head = np.minimum.accumulate(padded, axis=1).reshape(-1)
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(tail[starts - lo], head[starts - lo + width - 1]) & np.uint64((1 << int(at)) - 1)
    least = least.astype(np.int64)
    return least + lo, grams[least]


def _contexts(data, hashes, place, first, past, length, wanted):
    """The distinct contexts of the wanted anchors: first anchor of each, and every wanted anchor's context."""
    seen: dict[tuple[int, bytes], int] = {}
    of, firsts = np.empty(len(wanted), np.int64), []
    raw = data.tobytes()
    for i, a in enumerate(wanted.tolist()):
        key = (int(place[a] - first[a]), raw[first[a] : past[a] - 1 + length])
        of[i] = seen.setdefault(key, len(seen))
        if of[i] == len(firsts):
            firsts.append(a)
    return np.array(firsts, np.int64), of


def _hot_windows(data, anchors_of, first, past, length):
    """Starts of the windows of some anchors and their 96-bit hashes."""
    if not len(anchors_of):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    starts = np.concatenate([np.arange(first[a], past[a]) for a in anchors_of.tolist()])
    found = []
    for part in _parts(starts):
        values = (data[part[0] : part[-1] + length].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        values ^= values >> np.uint64(29)
        found.append([rolling_hashes(values, length, base)[part - part[0]] for base in BASES])
    long, short = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    long = (long ^ (long >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return starts, long, (short >> np.uint64(32)).astype(np.uint32)


# ---- the operator --------------------------------------------------------------------


def repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_first: bool = False,
    block_bytes: int = 4 << 20, group_bytes: int = 1 << 20, group_limit: int = 4096,
) -> DataFrame:
    """``id, n_bytes, spans, kept_bytes`` for every row: the texts' UTF-8 bytes without repeated strings.

    A byte goes if a string of ``length`` (>= 64) bytes of one text covers it that also stands at another
    place, in the same text or any other; with ``keep_first`` only the later copies go, in the order
    of the blocks that rows are dealt to.  ``spans`` are the maximal removed runs, end exclusive.

    Texts lie in blocks, shuffled once.  (1) Each window of ``length`` bytes has an anchor, the least
    hash among its short strings; only windows whose anchor occurs twice can repeat.  Blocks send
    their anchors' hashes, and get back which of them others have.  (2) The context of a shared
    anchor, the bytes of all its windows, goes to the group of its hash, once for each block and
    distinct context.  A group whose contexts are all equal repeats as a whole.  For the others, suffix
    order and longest previous (and next) factors tell which windows stand elsewhere too.  (3) An
    anchor with more than ``group_limit`` occurrences, a passage that a good part of all texts holds,
    would make too large a group: its windows are matched by 96-bit hash in spread buckets instead,
    one entry for each block and distinct window.  Nothing is capped.  A group as small as that is at
    most ``group_limit * 2 * length`` bytes.

    Texts that are null or shorter than ``length`` stay whole; rows equal in id and text are told apart
    by place, so a row that comes twice is a repetition.
    """
    blocks, size = in_blocks(texts_of(docs, id_col, text_col), block_bytes)
    buckets, groups = int(size // (8 << 20)) + 1, int(size // group_bytes) + 1

    def read(block: pa.Table):
        block = block.sort_by("row")
        texts = [t or b"" for t in block["text"].combine_chunks().cast(pa.binary()).to_pylist()]
        return block, texts, anchors(texts, length)

    def send(block: pa.Table) -> pa.Table:
        _, _, (_, _, hashes, *_) = read(block)
        values, counts = np.unique(hashes, return_counts=True)
        edge = bucket_edges(values, buckets)
        full = np.flatnonzero(np.diff(edge))
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "block": pa.array(np.full(len(full), block["block"][0].as_py()), pa.int64()),
            "hashes": pa.array([values[edge[k]:edge[k + 1]].tobytes() for k in full], pa.binary()),
            "counts": pa.array([counts[edge[k]:edge[k + 1]].astype(np.uint32).tobytes() for k in full], pa.binary()),
        })

    def count(bucket: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h, np.uint64) for h in bucket["hashes"].to_pylist()]
        _, where = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in bucket["counts"].to_pylist()])
        total = np.bincount(where, counts)[where]
        code = (total > 1).astype(np.uint8) + (total > group_limit)
        edge = np.cumsum([0] + [len(h) for h in hashes])
        codes = [code[edge[k]:edge[k + 1]].tobytes() for k in range(len(hashes))]
        return pa.table({"block": bucket["block"], "bucket": bucket["bucket"], "codes": pa.array(codes, pa.binary())})

    def coded(hashes, answers: pa.Table) -> np.ndarray:
        """0, 1 (shared) or 2 (hot) for every anchor of a block."""
        values, where = np.unique(hashes, return_inverse=True)
        rows = sorted(zip(answers["bucket"].to_pylist(), answers["codes"].to_pylist()))
        return np.frombuffer(b"".join(c for _, c in rows), np.uint8)[where]

    def contexts(block: pa.Table, answers: pa.Table) -> pa.Table:
        number = block["block"][0].as_py()
        _, _, (data, _, hashes, place, first, past) = read(block)
        code = coded(hashes, answers)
        wanted = np.flatnonzero(code == 1)
        firsts, of = _contexts(data, hashes, place, first, past, length, wanted)
        raw = data.tobytes()
        cold = pa.table({
            "bucket": pa.array((hashes[firsts] >> np.uint64(2)).astype(np.int64) % groups, pa.int64()),
            "block": pa.array(np.full(len(firsts), number), pa.int64()),
            "anchor": pa.array(firsts, pa.int64()),
            "hash": pa.array(hashes[firsts].view(np.int64), pa.int64()),
            "offset": pa.array(place[firsts] - first[firsts], pa.int64()),
            "starts": pa.array(past[firsts] - first[firsts], pa.int64()),
            "twice": pa.array(np.bincount(of, minlength=len(firsts)) > 1, pa.bool_()),
            "payload": pa.array([raw[f : p - 1 + length] for f, p in zip(first[firsts], past[firsts])], pa.binary()),
        })
        _, long, short = _hot_windows(data, np.flatnonzero(code == 2), first, past, length)
        hot = sent_hashes(number, long, short, buckets)
        blank = {n: pa.nulls(len(hot), cold.schema.field(n).type) for n in ("anchor", "hash", "offset", "starts", "twice")}
        hot = pa.table({"bucket": pc.add(hot["bucket"], groups), "block": hot["block"], **blank, "payload": hot["payload"]})
        return pa.concat_tables([cold, hot.select(cold.column_names)])

    def match(bucket: pa.Table) -> pa.Table:
        if bucket["bucket"][0].as_py() >= groups:
            answers = answers_to(bucket, keep_first)
            return pa.table({"kind": pa.array([2] * len(answers), pa.int32()), "block": answers["block"],
                             "bucket": pc.subtract(answers["bucket"], groups), "codes": answers["bits"]})
        bucket = bucket.sort_by([("hash", "ascending"), ("block", "ascending"), ("anchor", "ascending")])
        hashes, starts = bucket["hash"].to_numpy(), bucket["starts"].to_numpy()
        payloads = bucket["payload"].to_pylist()
        twice = bucket["twice"].to_numpy(zero_copy_only=False)
        kinds: dict[tuple, int] = {}
        kind = np.array([kinds.setdefault((h, o, p), len(kinds)) for h, o, p in zip(hashes.tolist(), bucket["offset"].to_pylist(), payloads)], np.int64)
        heads = np.unique(kind, return_index=True)[1]
        many = np.bincount(kind) > 1
        repeated = [np.full(n, bool(t)) for n, t in zip(starts.tolist(), many[kind] | (twice & (not keep_first)))]
        if keep_first:
            for row in heads.tolist():
                repeated[row][:] = False
        groups_of = hashes[heads]
        own, sizes = np.unique(groups_of, return_counts=True)
        mixed = heads[np.isin(groups_of, own[sizes > 1])]
        if len(mixed):
            mixed = np.sort(mixed)
            pieces = [payloads[r] + b"\xff" for r in mixed.tolist()]
            earlier, later = longest_factors(np.frombuffer(b"".join(pieces), np.uint8), length)
            found = earlier if keep_first else earlier | later
            begin = np.cumsum([0] + [len(p) for p in pieces])
            for row, at in zip(mixed.tolist(), begin.tolist()):
                repeated[row] |= found[at : at + starts[row]]
            by_kind = dict(zip(kind[mixed].tolist(), mixed.tolist()))
            for row in range(len(kind)):
                if (head := by_kind.get(int(kind[row]), row)) != row:
                    repeated[row] |= repeated[head]
        bits = [np.packbits(r).tobytes() for r in repeated]
        return pa.table({"kind": pa.array([1] * len(bits), pa.int32()), "block": bucket["block"],
                         "bucket": bucket["anchor"], "codes": pa.array(bits, pa.binary())})

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers["kind"].to_numpy()
        part = [answers.filter(pa.array(kind == k)) for k in range(3)]
        block, texts, (data, edges, hashes, place, first, past) = read(block)
        code = coded(hashes, part[0])
        wanted = np.flatnonzero(code == 1)
        firsts, of = _contexts(data, hashes, place, first, past, length, wanted)
        found = dict(zip(part[1]["bucket"].to_pylist(), part[1]["codes"].to_pylist()))
        starts = [np.zeros(0, np.int64)]
        for a, c in zip(wanted.tolist(), of.tolist()):
            n = past[a] - first[a]
            if keep_first and a != firsts[c]:
                starts.append(np.arange(first[a], past[a]))
            elif bits := found.get(int(firsts[c])):
                starts.append(first[a] + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n)))
        at, long, short = _hot_windows(data, np.flatnonzero(code == 2), first, past, length)
        hot = part[2].rename_columns(["kind", "block", "bucket", "bits"])
        starts.append(at[seen_hashes(long, short, hot, buckets, keep_first)] if len(at) else at)
        removed = covered(np.concatenate(starts), length, len(data))
        kept = ~removed
        kept[edges[1:] - 1] = False
        lo, hi = runs(removed)
        owner = np.searchsorted(edges, lo, "right") - 1
        spans = pa.StructArray.from_arrays(
            [pa.array(lo - edges[owner], pa.int64()), pa.array(hi - edges[owner], pa.int64())], ["start", "end"]
        )
        body, cut = data[kept].tobytes(), np.concatenate([[0], np.cumsum(kept)])[edges]
        return pa.table({
            "id": block["id"],
            "n_bytes": pa.array(np.diff(edges) - 1, pa.int64()),
            "spans": lists(spans, np.bincount(owner, minlength=len(texts))),
            "kept_bytes": pa.array([body[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
        })

    grouped = blocks.groupBy("block")
    codes = (
        grouped.applyInArrow(send, "bucket long, block long, hashes binary, counts binary")
        .groupBy("bucket").applyInArrow(count, "block long, bucket long, codes binary")
    )
    shared = grouped.cogroup(codes.groupBy("block")).applyInArrow(
        contexts, "bucket long, block long, anchor long, hash long, offset long, starts long, twice boolean, payload binary"
    )
    matched = shared.groupBy("bucket").applyInArrow(match, "kind int, block long, bucket long, codes binary")
    answers = codes.selectExpr("0 AS kind", "block", "bucket", "codes").union(matched)
    id_type = blocks.schema["id"].dataType.simpleString()
    return grouped.cogroup(answers.groupBy("block")).applyInArrow(
        finish, f"id {id_type}, n_bytes long, spans array<struct<start: long, end: long>>, kept_bytes binary"
    )
