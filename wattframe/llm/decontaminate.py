"""Documents that hold a benchmark item, by edit distance."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, rolling_hashes, split_words, strong_hashes, word_ids
from .ngram_join import sliced

#: Lower-case letters, digits and all bytes beyond ASCII stay; other ASCII bytes part words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Characters, in UTF-8, of scripts that write without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = re.compile(
    rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1(?:[\x80\x81\x9e\x9f][\x80-\xbf]|\x82[\x80-\x9f])|\xe3[\x81-\x83\x90-\xbf][\x80-\xbf]"
    rb"|[\xe4-\xe9][\x80-\xbf]{2}|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}"
)
#: Their punctuation: U+3000 to U+303F but for the marks of repetition and zero, and the wide forms of , . : ; ! ? ( ).
WIDE_MARKS = re.compile(rb"\xe3\x80[\x80-\x84\x88-\xbf]|\xef\xbc[\x81\x88\x89\x8c\x8e\x9a\x9b\x9f]|\xef\xbd[\xa1-\xa4]")
#: Items that are searched for at once; a larger benchmark takes several passes.
ITEM_BLOCK = 4096
WINDOWS = 1 << 14
SEED_BASE = 0x9E3779B97F4A7C15


class Items(NamedTuple):
    """Items of ``length`` words: ids, word hashes, and the embeddings to look for them by."""

    length: int
    edits: int
    ids: list
    hashes: np.ndarray
    tables: list


class Embedding(NamedTuple):
    """A random walk of ``3 * length`` steps, the sets of its output places that make keys, and the items' keys, ascending."""

    steps: np.ndarray
    samples: np.ndarray
    keys: np.ndarray
    items: np.ndarray  # the item of each key


def folded(text: bytes) -> bytes:
    """The text with its words parted by spaces; each character of a script without spaces is a word."""
    text = text.translate(FOLD)
    return text if text.isascii() else UNSPACED.sub(rb" \g<0> ", WIDE_MARKS.sub(b" ", text))


def embedded(windows: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """CGK embedding (Chakraborty, Goldenberg, Koucky, 2016) of rows of word hashes.

    A walk writes the word it stands on at every step, and moves on if a random bit of the step and the word
    says so.  Two walks that meet after an edit stay together, so few edits leave few differing places.  Past
    its end a row reads 0.  Returns a row for each step.
    """
    n = windows.shape[1]
    padded = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], axis=1).reshape(-1)
    at = np.arange(len(windows)) * (n + 1)  # the 0 past the end holds a walk there
    out = np.empty((len(steps), len(windows)), np.uint64)
    move = np.empty(len(windows), np.uint64)
    for word, step in zip(out, steps):
        np.take(padded, at, out=word, mode="clip")
        np.multiply(word, step, out=move)
        move >>= np.uint64(63)
        at += move.view(np.int64)
    return out


def keys_of(windows: np.ndarray, steps: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """A row for each sample, with one key for each window: a hash of the sample and the embedding's words at its places."""
    out = embedded(windows, steps)
    salt = np.arange(1, len(samples) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    keys = np.repeat(salt[:, None], len(windows), axis=1)
    for place in samples.T:
        keys ^= out[place]
        keys *= np.uint64(0x9FB21C651E98DF25)
        keys ^= keys >> np.uint64(32)
    return keys


def edit_distances(items: np.ndarray, segments: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance between each item and a prefix of its segment, and the length of that prefix (the shortest).

    Beyond ``most`` edits the distance is given as ``most + 1``: only the ``most`` places on either side of the diagonal
    are worked out, and a pair ends as soon as all of them are beyond.
    """
    pairs, n = items.shape
    width = segments.shape[1] + 1
    most = n + width if most is None else most
    kind = np.int16 if n + width < 1 << 13 else np.int64
    items, segments = np.ascontiguousarray(items.T), np.ascontiguousarray(segments.T)
    across = np.arange(width, dtype=kind)[:, None]
    row, alive = np.repeat(across, pairs, axis=1), np.arange(pairs)
    distance, size = np.full(pairs, most + 1, np.int64), np.zeros(pairs, np.int64)
    for i in range(n):
        lo, hi = max(0, i + 1 - most), min(width, i + 2 + most)
        if lo >= hi:
            return distance, size
        new = row[lo:hi] + kind(1)
        first = max(lo, 1)
        changed = row[first - 1 : hi - 1] + (segments[first - 1 : hi - 1] != items[i])
        np.minimum(new[first - lo :], changed, out=new[first - lo :])
        new -= across[lo:hi]
        np.minimum.accumulate(new, axis=0, out=new)
        np.add(new, across[lo:hi], out=row[lo:hi])
        row[:lo] = most + 1
        if i % 4 == 3:
            near = np.flatnonzero(row[lo:hi].min(axis=0) <= most)
            if 4 * len(near) < 3 * len(alive):
                alive, row, items, segments = alive[near], row[:, near], items[:, near], segments[:, near]
            if not len(alive):
                return distance, size
    found = row.min(axis=0)
    good = found <= most
    distance[alive[good]], size[alive[good]] = found[good], row.argmin(axis=0)[good]
    return distance, size


def _tables(length: int, edits: int, hashes: np.ndarray, recall: float, size: int = 3) -> list[Embedding]:
    """As many walks and samples as reach the recall for windows that differ from items by all the edits allowed.

    The chance that a sample agrees is measured on the items with random edits, walk by walk, until the
    chance that all walks so far miss falls below 1 - recall.
    """
    random = np.random.default_rng(length)
    copies = np.repeat(hashes, max(1, 200 // len(hashes)), axis=0)
    edited = np.stack([_edited(row, edits, length, random) for row in copies])
    of = np.arange(len(copies)) // max(1, 200 // len(hashes))
    missed, tables = np.ones(len(copies), bool), []
    while missed.mean() > 1 - recall and len(tables) < 400:
        steps = random.integers(0, 2**63, 3 * length).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        samples = random.integers(0, 3 * length, (16, size))
        keys = keys_of(hashes, steps, samples)
        missed &= ~(keys[:, of] == keys_of(edited, steps, samples)).any(axis=0)
        order = np.argsort(keys, axis=None)
        tables.append(Embedding(steps, samples, keys.reshape(-1)[order], order % len(hashes)))
    return tables


def _edited(row: np.ndarray, edits: int, length: int, random) -> np.ndarray:
    words = row.tolist()
    for _ in range(edits):
        kind, new = random.integers(3), int(random.integers(1, 2**63))
        at = int(random.integers(len(words))) if words else 0
        if kind == 0:
            words[at : at + 1] = [new]
        elif kind == 1:
            words.insert(at, new)
        else:
            del words[at : at + 1]
    return np.array((words + [0] * length)[:length], np.uint64)


def prepared(items: list[tuple], similarity: float, min_words: int, recall: float) -> list[Items]:
    """Items ``(id, text)`` by length; those of fewer than ``min_words`` words allow no edit."""
    by_length: dict[int, list] = {}
    for item, text in items:
        words = split_words([folded((text or "").encode())])
        own = [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends)]
        if own:
            by_length.setdefault(len(own), []).append((item, own))
    found = []
    for length, group in sorted(by_length.items()):
        edits = math.floor((1 - similarity) * length + 1e-9) if length >= min_words else 0
        hashes = np.stack([strong_hashes(words)[:, 0] for _, words in group])
        found.append(Items(length, edits, [item for item, _ in group], hashes, _tables(length, edits, hashes, recall)))
    return found


def find_items(texts: list[bytes], groups: list[Items]) -> list[list[dict]]:
    """For each text the items in it: id, first word, word past the last, and edit distance in words.

    Of an item's overlapping matches in a text the nearest stays, of equal ones the first.

    Windows begin where a match can begin: of ``edits + 1`` pieces of an item, one at least is left whole by
    ``edits`` edits, and moved by that many words at most.
    """
    words = split_words([folded(t) for t in texts])
    ids, distinct = word_ids(words)
    longest = max(g.length + g.edits for g in groups)
    # every text is followed by nothing, as long as the longest match
    first = words.first[:-1] + np.arange(len(texts)) * longest
    hashes = np.zeros(len(ids) + len(texts) * longest + longest, np.uint64)
    hashes[np.arange(len(ids)) + words.text_of * longest] = strong_hashes(distinct.to_pylist())[:, 0][ids]
    last = first + np.diff(words.first)
    found: list[list[dict]] = [[] for _ in texts]
    for group, starts in zip(groups, _starts(groups, hashes)):
        text = np.searchsorted(first, starts, "right") - 1
        starts = starts[(text >= 0) & (starts < last[text])]
        for at in range(0, len(starts), WINDOWS):
            for text, match in _matches(group, starts[at : at + WINDOWS], hashes, first):
                found[text].append(match)
    return [_nearest(matches) for matches in found]


def _starts(groups: list[Items], hashes: np.ndarray) -> list[np.ndarray]:
    """For each group the places where a match of one of its items can begin."""
    seeds: dict[int, list] = {}
    for number, group in enumerate(groups):
        pieces = group.edits + 1
        size = group.length // pieces
        for piece in range(pieces):
            at = piece * group.length // pieces
            values = group.hashes[:, at : at + size].copy()
            for row in values:
                seeds.setdefault(size, []).append((rolling_hashes(row, size, SEED_BASE)[0], number, at))
    found = [[np.zeros(0, np.int64)] for _ in groups]
    for size, own in seeds.items():
        keys = np.array([k for k, *_ in own], np.uint64)
        order = np.argsort(keys)
        keys, number, offset = keys[order], *(np.array([o[c] for o in own])[order] for c in (1, 2))
        grams = rolling_hashes(hashes, size, SEED_BASE)
        listed = np.zeros(1 << 20, bool)
        listed[_slot(keys)] = True
        at = np.flatnonzero(listed[_slot(grams)])
        lo, hi = (np.searchsorted(keys, grams[at], side) for side in ("left", "right"))
        many = hi - lo
        place = np.repeat(at, many)
        seed = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        begin, group_of = place - offset[seed], number[seed]
        for g in np.unique(group_of):
            spread = np.arange(-groups[g].edits, groups[g].edits + 1)
            found[g].append(np.unique(begin[group_of == g][:, None] + spread))
    return [np.unique(np.concatenate(f)) for f in found]


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)


def _matches(group: Items, starts: np.ndarray, hashes: np.ndarray, first: np.ndarray):
    """Matches of a group's items that begin at the starts: by key, then by edit distance."""
    windows = hashes[starts[:, None] + np.arange(group.length)]
    hits = [np.zeros(0, np.int64)]
    for table in group.tables:
        own = keys_of(windows, table.steps, table.samples).reshape(-1)
        lo = np.searchsorted(table.keys, own)
        hit = np.flatnonzero(table.keys[np.minimum(lo, len(table.keys) - 1)] == own)
        lo, many = lo[hit], np.searchsorted(table.keys, own[hit], "right") - lo[hit]
        at = np.repeat(hit % len(starts), many)
        item = table.items[np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        hits.append(at * len(group.ids) + item)
    pairs = np.unique(np.concatenate(hits))
    for lo in range(0, len(pairs), WINDOWS):
        at, item = np.divmod(pairs[lo : lo + WINDOWS], len(group.ids))
        segments = hashes[starts[at][:, None] + np.arange(group.length + group.edits)]
        distance, size = edit_distances(group.hashes[item], segments, group.edits)
        good = np.flatnonzero(distance <= group.edits)
        text = np.searchsorted(first, starts[at[good]], "right") - 1
        for t, g in zip(text.tolist(), good.tolist()):
            start = int(starts[at[g]] - first[t])
            yield t, {
                "item_id": group.ids[item[g]], "start": start, "end": start + int(size[g]), "distance": int(distance[g]),
            }


def _nearest(matches: list[dict]) -> list[dict]:
    kept: list[dict] = []
    for m in sorted(matches, key=lambda m: (m["distance"], m["start"])):
        if not any(k["item_id"] == m["item_id"] and k["start"] < m["end"] and m["start"] < k["end"] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m["start"], m["item_id"]))


def benchmark_matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", similarity: float = 0.75, min_words: int = 8, recall: float = 0.99, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id, matches`` (and the ``keep`` columns) for every row of ``docs``; ``matches`` lists item, span in words, and edit distance.

    Words are runs of letters and digits, with A-Z lowered, and single characters of scripts without spaces.  An item of n words is in a text if some run of the
    text's words is at most ``(1 - similarity) * n`` word edits away.  Windows of n words are looked at wherever a match can
    begin, as one of the pieces between its edits stands there unchanged: by repeated bit-sampling of random-walk embeddings, enough for
    ``recall`` at the largest distance allowed, and exactly by edit distance at last.

    The items are read in blocks of ITEM_BLOCK and sent to the tasks; texts are not shuffled, and an item
    or passage that stands in many texts costs each text the same.  Items of fewer than ``min_words`` words are found
    as they stand, as a whole run of words; null or empty ones are not searched for.  A null or empty text has no match.  Items of equal id are told apart
    only by their texts.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    item_type = items.schema[item_col].dataType.simpleString()
    rest = [f for f in texts.schema.fields if f.name != "text"]
    match = f"array<struct<item_id: {item_type}, start: int, end: int, distance: int>>"
    item_arrow = pa.string() if item_type == "string" else pa.int32() if item_type == "int" else pa.int64()
    blocks, block = [], []
    for row in items.select(item_col, item_text_col).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEM_BLOCK:
            blocks.append(prepared(_numbered(block), similarity, min_words, recall))
            block = []
    blocks.append(prepared(_numbered(block), similarity, min_words, recall))
    blocks = [b for b in blocks if b]

    def search(batches):
        for batch, part in sliced(batches, "text"):
            found = [[] for _ in part]
            for groups in blocks:
                for all_, new in zip(found, find_items(part, groups)):
                    all_ += [{**m, "item_id": m["item_id"][0]} for m in new]
            flat = [m for matches in found for m in matches]
            fields = [pa.array([m["item_id"] for m in flat], item_arrow), *(
                pa.array([m[c] for m in flat], pa.int32()) for c in ("start", "end", "distance")
            )]
            values = pa.StructArray.from_arrays(fields, ["item_id", "start", "end", "distance"])
            counts = np.array([len(m) for m in found], np.int64)
            yield pa.RecordBatch.from_pydict({**{f.name: batch.column(f.name) for f in rest}, "matches": lists(values, counts)})

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest]
    return texts.mapInArrow(search, ", ".join([*columns, f"matches {match}"]))


def _numbered(items: list[tuple]) -> list[tuple]:
    """Items by (id, place), so that two of one id are both searched for."""
    return [((item, k), text) for k, (item, text) in enumerate(items)]
