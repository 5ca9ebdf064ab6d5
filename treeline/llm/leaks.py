"""Evaluation passages inside training documents: which document carries which held-out item, whole or in part.

Items are cut into windows of `window` words, one every `STRIDE` words and one at the end, so that an excerpt of
window + STRIDE - 1 words holds a whole window. These and the windows at every position of every document get a 64-bit
SimHash. A multi-index over three blocks of 21 and 22 bits finds all item windows within Hamming distance 11 of a
document's: one of the three blocks must then differ in 3 bits at most, and each item window is filed under all values of
each block that near. So no window at that radius is missed, though a word in six was altered. The candidate pairs are then
verified on the words: five-word shingles that document and item share, chained in order of place. A standing notice is told
by standing in several different items; its shingles weigh nothing. All others count in full, however many documents carry
them. A document carries an item if the words of its chains reach `min_words`, in one piece or in several.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 17
STRIDE = 8
RADIUS = 11
BLOCK_BITS = (21, 21, 22)
SHINGLE = 5
MIN_WORDS = 20.0
#: A chain of fewer words is a stock phrase; in a chain, shared shingles are at most GAP words apart and DRIFT out of step.
CHAIN_WORDS = 10
GAP = 30
DRIFT = 12
#: Words in one run that different items share from which on it is a standing notice, not a stock phrase.
NOTICE_WORDS = 10
#: Passages that share this much of the shorter one are copies of each other; what they share is no notice.
COPY_SHARE = 0.75
#: Item windows that are indexed at once (12 kB each); more items are taken in blocks, each with a pass over the documents.
BLOCK_WINDOWS = 16_000

FOUND = "doc_id bigint, item_id bigint, words double"

_MARKUP = re.compile(r"<[^<>\n]{1,200}>|&#?\w{2,8};")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case, without markup."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.lower())


class Vocabulary:
    """Words as numbers, with a hash and 64 signs each. Forgets everything once it holds `most` words."""

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)
        self.signs = np.zeros((0, 64), np.int8)

    def numbers(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self.number
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            for w in fresh:
                known[w] = len(known)
            h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in fresh], np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            self.hashes = np.concatenate([self.hashes, h])
            self.signs = np.concatenate([self.signs, bits.astype(np.int8) * 2 - 1])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def simhashes(signs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The SimHash of each window of so many rows; an odd window leaves no ties."""
    n = len(signs) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, have, at = None, 0, 0
    part, size = signs, 1
    while have < window:  # sums of 1, 2, 4, ... rows, of which the window is put together
        if (window >> (size.bit_length() - 1)) & 1:
            piece = part[at : at + n]
            total = piece.copy() if total is None else total + piece
            at += size
            have += size
        if have < window:
            part = part[:-size] + part[size:]
            size *= 2
    return np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_keys(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit key of each run of so many words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = (key ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def near_values(bits: int, flips: int) -> np.ndarray:
    """All masks of so many bits with at most `flips` bits set."""
    ones = [1 << k for k in range(bits)]
    return np.array([sum(c) for n in range(flips + 1) for c in combinations(ones, n)], np.int64)


class BlockIndex:
    """Fingerprints filed by each of their blocks, under every value that differs in radius // blocks bits at most."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, bits: tuple[int, ...] = BLOCK_BITS):
        self.prints, self.radius = prints, radius
        self.shifts = np.cumsum([0, *bits[:-1]]).tolist()
        self.masks = [(1 << b) - 1 for b in bits]
        self.blocks = []
        for k, b in enumerate(bits):
            near = self._block(prints, k)[:, None] ^ near_values(b, radius // len(bits))
            filed = np.sort((near << 24 | np.arange(len(prints))[:, None]).ravel())
            start = np.zeros((1 << b) + 1, np.int64)
            np.cumsum(np.bincount(filed >> 24, minlength=1 << b), out=start[1:])
            self.blocks.append((start.astype(np.int32), (filed & 0xFFFFFF).astype(np.int32)))

    def _block(self, prints: np.ndarray, k: int) -> np.ndarray:
        return ((prints >> np.uint64(self.shifts[k])) & np.uint64(self.masks[k])).astype(np.int64)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): all pairs with Hamming distance <= radius of prints[i] and the indexed j; may repeat."""
        left, right = [], []
        for k, (start, filed) in enumerate(self.blocks):
            value = self._block(prints, k)
            first, count = start[value], start[value + 1] - start[value]
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            count = count[hit]
            i = np.repeat(hit, count)
            inner = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            j = filed[np.repeat(first[hit], count) + inner]
            near = np.bitwise_count(prints[i] ^ self.prints[j]) <= self.radius
            left.append(i[near])
            right.append(j[near])
        none = np.zeros(0, np.int64)
        return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


class Items:
    """The items of one block: fingerprints of their windows and their shingles."""

    def __init__(self, items: list[tuple[int, str, list[int]]], radius: int = RADIUS):
        vocabulary = Vocabulary()
        self.ids = np.array([i for i, _, _ in items], np.int64)
        prints, print_of, keys, key_of, key_at, weight = [], [], [], [], [], []
        for k, (_, text, standing) in enumerate(items):
            numbers = vocabulary.numbers(words_of(text))
            p, s = simhashes(vocabulary.signs[numbers]), shingle_keys(vocabulary.hashes[numbers])
            p = p[sorted({*range(0, len(p), STRIDE), *([len(p) - 1] if len(p) else [])})]
            prints.append(p)
            print_of.append(np.full(len(p), k, np.int32))
            keys.append(s)
            key_of.append(np.full(len(s), k, np.int32))
            key_at.append(np.arange(len(s), dtype=np.int32))
            weight.append(~np.isin(key_at[-1], standing))
        self.index = BlockIndex(np.concatenate(prints), radius)
        self.print_of = np.concatenate(print_of)
        all_keys = np.concatenate(keys)
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.key_of, self.key_at, self.key_weight = all_keys[order], *(np.concatenate(x)[order] for x in (key_of, key_at, weight))

    def candidates(self, prints: np.ndarray, doc_of: np.ndarray, n_docs: int) -> np.ndarray:
        """For each doc * items + item whether windows of both are near each other."""
        i, j = self.index.within(prints)
        out = np.zeros(n_docs * len(self.ids), bool)
        out[doc_of[i] * len(self.ids) + self.print_of[j]] = True
        return out

    def shared(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, k): places i whose key is that of the item shingle k (in the sorted order)."""
        first = np.searchsorted(self.keys, keys, "left")
        hit = np.flatnonzero(first < len(self.keys))
        hit = hit[self.keys[first[hit]] == keys[hit]]
        count = np.searchsorted(self.keys, keys[hit], "right") - first[hit]
        i = np.repeat(hit, count)
        return i, np.repeat(first[hit], count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


def covered(at: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """How many words each of the sorted places adds to those before it."""
    return np.minimum(np.diff(at, prepend=at[:1] - size), size)


def standing_places(passages: list[list[str]]) -> list[list[int]]:
    """For each passage the places of its shingles that belong to a standing notice.

    A notice is a run of shingles that a different passage has too. Passages that are copies of each other, or neighbouring
    cuts of one text (the end of one is the beginning of the other), share their text and no notice.
    """
    number: dict[tuple[str, ...], int] = {}
    known = [number.setdefault(tuple(p), len(number)) for p in passages]  # equal passages count once
    distinct = [list(p) for p in number]
    shingles = [[tuple(p[k : k + SHINGLE]) for k in range(len(p) - SHINGLE + 1)] for p in distinct]
    places: list[dict[tuple[str, ...], int]] = [dict(zip(reversed(s), reversed(range(len(s))))) for s in shingles]
    holders: dict[tuple[str, ...], list[int]] = {}
    for i, at in enumerate(places):
        for s in at:
            holders.setdefault(s, []).append(i)

    def shared(i: int, j: int) -> set[int]:
        """The places of i that are a notice if j is the other passage."""
        mine = np.array([k for k, s in enumerate(shingles[i]) if s in places[j]])
        if covered(mine).sum() >= COPY_SHARE * min(len(distinct[i]), len(distinct[j])):
            return set()
        found: set[int] = set()
        for run in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1):
            first, last = int(run[0]), int(run[-1])
            there = places[j][shingles[i][first]], places[j][shingles[i][last]]
            ends, ends_there = last == len(shingles[i]) - 1, there[1] == len(shingles[j]) - 1
            neighbours = (ends and there[0] == 0 and not ends_there) or (first == 0 and ends_there and there[0] > 0)
            if last - first + SHINGLE >= NOTICE_WORDS and not neighbours:
                found.update(run.tolist())
        return found

    out = []
    for i, own in enumerate(shingles):
        notice: set[int] = set()
        seen = {i}
        for k, s in enumerate(own):
            for j in holders[s]:
                if k in notice:
                    break
                if j not in seen:
                    seen.add(j)
                    notice |= shared(i, j)
        out.append(sorted(notice))
    return [out[k] for k in known]


@dataclass(frozen=True)
class Proof:
    """What a candidate must show: words in all its chains, words in each, and how loose a chain may be."""

    min_words: float = MIN_WORDS
    chain_words: float = CHAIN_WORDS
    gap: int = GAP
    drift: int = DRIFT


def _sums(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The sum over each value's group; group: numbers from 0 without gaps."""
    return np.bincount(group, values)[group]


def _told_words(pair: np.ndarray, place: np.ndarray, at: np.ndarray, weight: np.ndarray, proof: Proof) -> tuple[np.ndarray, np.ndarray]:
    """(pair, words) of shared shingles: chains in order of place, close together and in step; the words of long enough ones, summed."""
    order = np.lexsort((at, place, pair))
    pair, place, at, weight = pair[order], place[order], at[order], weight[order]
    cut = (np.diff(pair) != 0) | (np.diff(place) > proof.gap) | (np.abs(np.diff(place - at)) > proof.drift)
    chain = np.concatenate([[0], np.cumsum(cut)])
    order = np.lexsort((at, chain))  # each item place once a chain
    once = order[np.concatenate([[True], (np.diff(chain[order]) != 0) | (np.diff(at[order]) != 0)])]
    chain, at, pair, weight = chain[once], at[once], pair[once], weight[once]
    fresh = np.concatenate([[True], np.diff(chain) != 0])
    long = _sums(np.where(fresh, SHINGLE, np.minimum(np.diff(at, prepend=0), SHINGLE)), chain) >= proof.chain_words
    at, pair, weight = at[long], pair[long], weight[long]
    if not len(pair):
        return pair, np.zeros(0)
    order = np.lexsort((at, pair))  # and once over all chains of a pair
    once = order[np.concatenate([[True], (np.diff(pair[order]) != 0) | (np.diff(at[order]) != 0)])]
    at, pair, weight = at[once], pair[once], weight[once]
    fresh = np.concatenate([[True], np.diff(pair) != 0])
    words = weight * np.where(fresh, SHINGLE, np.minimum(np.diff(at, prepend=0), SHINGLE))
    return pair[fresh], np.add.reduceat(words, np.flatnonzero(fresh))


def scan_texts(items: Items, docs: list[tuple[int, list[str]]], vocabulary: Vocabulary, proof: Proof) -> Iterator[tuple[int, int, float]]:
    """(doc_id, item_id, words) of each verified pair: its chains cover at least min_words words outside standing notices."""
    numbers = [vocabulary.numbers(w) for _, w in docs]
    lengths = np.array([len(n) for n in numbers])
    flat = np.concatenate(numbers)
    doc_at = np.repeat(np.arange(len(docs)), lengths)
    prints = simhashes(vocabulary.signs[flat])
    where = np.flatnonzero(doc_at[: len(prints)] == doc_at[len(doc_at) - len(prints) :])
    candidate = items.candidates(prints[where], doc_at[where], len(docs))
    asked = candidate.reshape(len(docs), -1).any(1)
    keys = shingle_keys(vocabulary.hashes[flat])
    where = np.flatnonzero(asked[doc_at[: len(keys)]] & (doc_at[: len(keys)] == doc_at[SHINGLE - 1 :]))
    i, k = items.shared(keys[where])
    i, n_items = where[i], len(items.ids)
    pair = doc_at[i] * n_items + items.key_of[k]
    good = candidate[pair]
    if not good.any():
        return
    found, words = _told_words(pair[good], i[good], items.key_at[k[good]].astype(np.int64), items.key_weight[k[good]], proof)
    for p, w in zip(found.tolist(), words.tolist()):
        if w >= proof.min_words:
            yield docs[p // n_items][0], int(items.ids[p % n_items]), w


def item_blocks(items: DataFrame, item_id: str, passage: str, block_windows: int) -> list[list[tuple[int, str, list[int]]]]:
    """The query set on the driver, each item with the places of its standing notices, in blocks of bounded size."""
    blocks: list[list[tuple[int, str, list[int]]]] = [[]]
    size = 0
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(passage).alias("p")).where("i IS NOT NULL AND p IS NOT NULL").distinct().orderBy("i").collect()
    for r, standing in zip(rows, standing_places([words_of(r.p) for r in rows])):
        n = r.p.count(" ") // STRIDE + 2
        if blocks[-1] and size + n > block_windows:
            blocks.append([])
            size = 0
        blocks[-1].append((r.i, r.p, standing))
        size += n
    return [b for b in blocks if b]


def chains(docs: DataFrame, block: list[tuple[int, str, list[int]]], proof: Proof, radius: int = RADIUS, chunk_words: int = 60_000) -> DataFrame:
    """FOUND rows of all documents (doc_id, text) for one block of items: one pass, no shuffle."""

    key = uuid.uuid4().hex

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a Python worker that runs several tasks builds the index once
        kept = sys.modules.setdefault("_treeline_items", {})
        if key not in kept:
            kept.clear()
            kept[key] = Items(block, radius)
        items, vocabulary = kept[key], Vocabulary()
        names = ["doc_id", "item_id", "words"]

        def flush(part: list) -> pd.DataFrame:
            found = list(scan_texts(items, part, vocabulary, proof))
            if len(vocabulary.number) > vocabulary.most:
                vocabulary.clear()
            return pd.DataFrame(found, columns=names)

        part, size = [], 0
        for batch in batches:
            for d, t in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                words = words_of(t)
                if len(words) >= WINDOW:
                    part.append((d, words))
                    size += len(words)
                    if size >= chunk_words:
                        out = flush(part)
                        if len(out):
                            yield out
                        part, size = [], 0
        if part:
            out = flush(part)
            if len(out):
                yield out

    return docs.mapInPandas(scan, FOUND)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    proof: Proof = Proof(),
    radius: int = RADIUS,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """(doc_id, item_id, words): the documents that carry an item's passage or part of it, and how much (words outside standing notices).

    NULL ids, texts and passages and texts shorter than a window give no row; passages of fewer than WINDOW words are not
    looked for; repeated documents and items give one row a pair; very long texts are scanned whole; no items or no
    documents: an empty result. How many documents carry an item makes no difference.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    blocks = item_blocks(items, item_id, passage, block_windows)
    if not blocks:
        return spark.createDataFrame([], FOUND)
    found = chains(rows, blocks[0], proof, radius)
    for block in blocks[1:]:
        found = found.unionByName(chains(rows, block, proof, radius))
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
