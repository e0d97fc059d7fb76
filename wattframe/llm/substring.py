"""Removal of token sequences that occur more than once in a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import covered, in_blocks, lists, rolling_hashes, runs, split_words, strong_hashes, texts_of, word_ids

#: Odd multipliers of the two rolling hashes; any odd numbers do.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def window_hashes(words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window that lies within one text, and its 64-bit and 32-bit hashes."""
    ids, distinct = word_ids(words)
    texts = words.text_of
    starts = np.flatnonzero(texts[: max(0, len(texts) - length + 1)] == texts[length - 1 :])
    strong = strong_hashes(distinct.to_pylist())
    long, short = (rolling_hashes(strong[ids, k], length, BASES[k])[starts] for k in (0, 1))
    long = (long ^ (long >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return starts, long, (short >> np.uint64(32)).astype(np.uint32)


def distinct_pairs(long: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the pairs, where each distinct pair begins in it, and the class of every pair."""
    order = np.argsort(long, kind="stable")
    a, b = long[order], short[order]
    tied = a[1:] == a[:-1]
    if (tied & (b[1:] != b[:-1])).any():
        order = np.lexsort((short, long))
        a, b = long[order], short[order]
        tied = a[1:] == a[:-1]
    new = np.concatenate([[True], ~(tied & (b[1:] == b[:-1]))])[: len(order)]
    classes = np.empty(len(order), np.int64)
    classes[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), classes


def _packed(long: np.ndarray, short: np.ndarray) -> bytes:
    """Ascending 64-bit values as gaps, byte by byte, so that the gaps' zero bytes cost nothing; then the others."""
    gaps = np.concatenate([long[:1], np.diff(long)])
    first, gaps[0] = gaps[0].tobytes(), 0
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + first + planes.tobytes() + short.tobytes()


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, first = payload[0], np.frombuffer(payload, np.uint64, 1, 1)
    n = (len(payload) - 9) // (width + 4)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(payload, np.uint8, n * width, 9).reshape(width, n).T
    long = np.cumsum(gaps.reshape(-1).view(np.uint64)) + first
    return long, np.frombuffer(payload, np.uint32, n, 9 + n * width)


def bucket_edges(long: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of 64-bit values begins in ascending ``long``."""
    width = 2**64 // buckets + 1
    inner = np.array([k * width for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(long, inner), [len(long)]])


def sent_hashes(block: int, long: np.ndarray, short: np.ndarray, buckets: int) -> pa.Table:
    """One row per bucket with the distinct hashes of a block that fall into it, packed."""
    order, begins, _ = distinct_pairs(long, short)
    long, short = long[order[begins]], short[order[begins]]
    edges = bucket_edges(long, buckets)
    full = np.flatnonzero(np.diff(edges))
    payload = [_packed(long[edges[k]:edges[k + 1]], short[edges[k]:edges[k + 1]]) for k in full]
    return pa.table({
        "bucket": pa.array(full, pa.int64()),
        "block": pa.array(np.full(len(full), block), pa.int64()),
        "payload": pa.array(payload, pa.binary()),
    })


def answered_hashes(sent: DataFrame, earlier: bool = False) -> DataFrame:
    """For every row of ``sent_hashes`` one bit a hash: another block has it too (``earlier``: a lower block has)."""

    return sent.groupBy("bucket").applyInArrow(lambda t: answers_to(t, earlier), "bucket long, block long, bits binary")


def answers_to(bucket: pa.Table, earlier: bool = False) -> pa.Table:
    """The answers to all that was sent to one bucket."""
    bucket = bucket.sort_by("block")
    sent = [_unpacked(p) for p in bucket["payload"].to_pylist()]
    order, begins, classes = distinct_pairs(*(np.concatenate([s[k] for s in sent]) for k in (0, 1)))
    if earlier:
        seen = np.ones(len(order), bool)
        seen[order[begins]] = False
    else:
        seen = np.diff(np.append(begins, len(classes)))[classes] > 1
    edges = np.cumsum([0] + [len(s[0]) for s in sent])
    bits = [np.packbits(seen[edges[k]:edges[k + 1]]).tobytes() for k in range(len(sent))]
    return pa.table({"bucket": bucket["bucket"], "block": bucket["block"], "bits": pa.array(bits, pa.binary())})


def seen_hashes(long: np.ndarray, short: np.ndarray, answers: pa.Table, buckets: int, earlier: bool = False) -> np.ndarray:
    """Which of a block's hashes stand at another place (``earlier``: at an earlier place), by the bits that came back."""
    order, begins, classes = distinct_pairs(long, short)
    edges = bucket_edges(long[order[begins]], buckets)
    elsewhere = np.zeros(len(begins), bool)
    for bucket, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist()):
        n = edges[bucket + 1] - edges[bucket]
        elsewhere[edges[bucket]:edges[bucket + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    if earlier:
        here = np.ones(len(order), bool)
        here[order[begins]] = False
    else:
        here = (np.diff(np.append(begins, len(order))) > 1)[classes]
    return elsewhere[classes] | here


def repeated_sequences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35,
    block_bytes: int = 16 << 20, bucket_windows: int = 1 << 22,
) -> DataFrame:
    """``id, n_words, spans, kept_text`` for every row of ``docs``.

    A window is ``length`` consecutive words of one text.  Windows whose words also stand at another
    place, in the same text or any other, are repeated; ``spans`` are the maximal runs of words that
    repeated windows cover, as ``start, end`` in words, end exclusive.  ``kept_text`` joins the other
    words by one space.

    Every window gets a Rabin-Karp hash of 96 bits.  Texts lie in blocks; a block sends each distinct
    hash once, packed, to the bucket of its range, and the bucket answers with one bit for each: seen
    in another block or not.  So a passage that stands in a third of all texts costs one entry per
    block, and the hashes are the only data that grow with the corpus besides the texts themselves.
    The texts are shuffled once, for both visits.

    A text that is null, or shorter than a window, keeps all its words.  Rows of equal id or text are
    told apart by their place, so a row that comes twice is a repetition.
    """
    blocks, size = in_blocks(texts_of(docs, id_col, text_col), block_bytes)
    buckets = int(size // 6 // bucket_windows) + 1

    def send(block: pa.Table) -> pa.Table:
        _, long, short = window_hashes(split_words(block["text"].combine_chunks()), length)
        return sent_hashes(block["block"][0].as_py(), long, short, buckets)

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        block = block.sort_by("row")
        words = split_words(block["text"].combine_chunks())
        starts, long, short = window_hashes(words, length)
        removed = covered(starts[seen_hashes(long, short, answers, buckets)], length, len(words.starts))
        return pa.table({
            "id": block["id"],
            "n_words": pa.array(np.diff(words.first), pa.int64()),
            "spans": _spans(removed, words),
            "kept_text": _kept(removed, words),
        })

    grouped = blocks.groupBy("block")
    sent = grouped.applyInArrow(send, "bucket long, block long, payload binary")
    answers = answered_hashes(sent)
    id_type = blocks.schema["id"].dataType.simpleString()
    return grouped.cogroup(answers.groupBy("block")).applyInArrow(
        finish, f"id {id_type}, n_words long, spans array<struct<start: long, end: long>>, kept_text string"
    )


def _spans(removed: np.ndarray, words) -> pa.Array:
    """Maximal removed runs by text; a run ends with its text."""
    texts = words.text_of
    change = np.diff(np.concatenate([[-1], np.where(removed, texts, -1), [-1]]))
    at = np.flatnonzero(change)
    starts = at[removed[np.minimum(at, len(removed) - 1)] & (at < len(removed))] if len(removed) else at
    ends = at[removed[at - 1] & (at > 0)] if len(removed) else at
    owner = texts[starts] if len(starts) else starts
    base = words.first[:-1][owner] if len(owner) else owner
    values = pa.StructArray.from_arrays(
        [pa.array(starts - base, pa.int64()), pa.array(ends - base, pa.int64())], ["start", "end"]
    )
    return lists(values, np.bincount(owner, minlength=len(words.first) - 1))


def _kept(removed: np.ndarray, words) -> pa.Array:
    """The kept words of each text, joined by one space."""
    kept = np.flatnonzero(~removed)
    texts = words.text_of[kept]
    last = np.append(texts[1:] != texts[:-1], True)[: len(kept)]
    ends = words.ends[kept] + ~last
    change = np.zeros(len(words.data) + 2, np.int8)
    change[words.starts[kept]] += 1
    change[ends] -= 1
    data = words.data.copy()
    data[words.ends] = 32
    body = data[np.cumsum(change, dtype=np.int8)[: len(data)] > 0]
    sizes = np.bincount(texts, ends - words.starts[kept], len(words.first) - 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return column.cast(pa.string())
