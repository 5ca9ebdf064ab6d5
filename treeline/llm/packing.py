"""Texts of varying length packed into containers of a fixed number of tokens.

Bounded-space online best-fit. A task keeps a fixed number of open bins in a bitset keyed by free space; a text goes into
the fullest bin that still holds it, found with two bit operations. If none does, a new bin is opened, and if that is one
too many, the fullest open bin closes first. So there is no shuffle of the texts. The bins that are still open at the end of
a task are carried on: the tasks' open bins meet in rounds, a few tasks at a time, where the first task's bins stay as they
are and the texts of the others' come to them by the same rule, until one set of open bins is left.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import materialise

CAPACITY = 2048
OPEN_BINS = 512
#: Tasks whose open bins meet in one task of the next round.
FAN_IN = 8
#: Texts without tokens that wait for a bin to close, at most.
EMPTY_ROWS = 100_000
# Fixed value: how the tokenizer of byte_bpe_50k divides a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PACKED = "doc_id bigint, piece_no int, n_tokens int, container_id string, task int, closed boolean"


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """A tiktoken encoder from a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("treeline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Packer:
    """Open bins by free space; each holds its rows until it closes. Bins are named after the task and their number in it."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task: str = ""):
        self.capacity, self.limit, self.task = capacity, open_bins, task
        self.bits, self.count, self.opened = 0, 0, 0
        self.by_free: list[list[tuple[str, list]]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> tuple[str, list]:
        bins = self.by_free[free]
        taken = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return taken

    def _put(self, free: int, bin_: tuple[str, list]) -> None:
        self.by_free[free].append(bin_)
        self.bits |= 1 << free

    def carry(self, name: str, free: int, rows: list) -> None:
        """Go on with an open bin of another task."""
        self._put(free, (name, rows))
        self.count += 1

    def close(self) -> tuple[str, list] | None:
        """The fullest open bin, which is closed by that; None if there is none."""
        if not self.count:
            return None
        self.count -= 1
        return self._take((self.bits & -self.bits).bit_length() - 1)

    def add(self, size: int, row: tuple) -> tuple[str, list] | None:
        """Put a row of so many tokens, 0 <= size <= capacity, into a bin; the bin that had to close for that, if any."""
        fitting = self.bits >> size
        closed = None
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count >= self.limit:
                closed = self.close()
            free, bin_ = self.capacity, (f"{self.task}-{self.opened}", [])
            self.opened += 1
            self.count += 1
        bin_[1].append(row)
        self._put(free - size, bin_)
        return closed


def pieces(n_tokens: int, capacity: int) -> list[int]:
    """The sizes of a text's pieces: itself, or full containers and a rest if it alone exceeds the capacity."""
    full, rest = divmod(n_tokens, capacity)
    return [n_tokens] if n_tokens <= capacity else [capacity] * full + [rest] * (rest > 0)


_COLUMNS = [c.split(" ")[0] for c in PACKED.split(", ")]


def _table(bins: list[tuple[str, list]], task: int, closed: bool) -> pd.DataFrame:
    rows = [(*row, name, task, closed) for name, held in bins for row in held]
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"doc_id": "int64", "piece_no": "int32", "n_tokens": "int32", "task": "int32"})


def _pack(rows: Iterable[tuple[int, int, int]], packer: Packer, task: int, last: bool) -> Iterator[pd.DataFrame]:
    """(doc, piece, size) rows into rows of PACKED; closed=False for what lies in bins that are open at the end, unless last.

    A row without tokens fits everywhere and waits for the next bin to close, so that no open bin grows with their number.
    """
    done: list[tuple[str, list]] = []
    n_rows, empty = 0, []

    def finish(bin_: tuple[str, list]) -> None:
        nonlocal n_rows
        bin_[1].extend(empty)
        empty.clear()
        done.append(bin_)
        n_rows += len(bin_[1])

    for row in rows:
        if row[2] == 0:
            empty.append(row)
            if len(empty) >= EMPTY_ROWS:
                finish(packer.close() or (f"{task}-empty-{packer.task}-{n_rows}", []))
        elif (closed := packer.add(row[2], row)) is not None:
            finish(closed)
        if n_rows >= 20_000:
            yield _table(done, task, True)
            done, n_rows = [], 0
    if empty:
        for row in empty:
            packer.add(0, row)
    if done:
        yield _table(done, task, True)
    yield _table([b for bins in packer.by_free for b in bins], task, last)


def _first_and_rest(batches: Iterable[pd.DataFrame], packer: Packer) -> Iterator[tuple[int, int, int]]:
    """Carries the open bins of the first task among the rows and yields the rows of the others."""
    left = pd.concat(list(batches))
    first = left["task"].min()
    for name, held in left[left["task"] == first].groupby("container_id", sort=True):
        rows = list(zip(held["doc_id"].tolist(), held["piece_no"].tolist(), held["n_tokens"].tolist()))
        packer.carry(name, packer.capacity - int(held["n_tokens"].sum()), rows)
    rest = left[left["task"] != first].sort_values(["task", "container_id", "doc_id", "piece_no"])
    yield from zip(rest["doc_id"].tolist(), rest["piece_no"].tolist(), rest["n_tokens"].tolist())


def pack_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, path: str | None = None, rounds: bool = True
) -> DataFrame:
    """(doc_id, piece_no, n_tokens, container_id): the container of each text or piece.

    A text longer than the capacity is divided into full containers and a rest (piece_no 0, 1, ...); no other is divided.
    NULL and empty texts have 0 tokens and share a container like any other; NULL ids are left out. Repeated rows are packed
    as separate texts of one id; containers are named after the task that opened them and a number, so none is mixed up
    with another. An empty table gives an empty result. path: the vocabulary, the same on all machines; by default each task
    looks it up. rounds: whether open bins are carried on after the tasks, or else stay as they are.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        encode = encoder(path or tokenizer_file()).encode_ordinary

        def sized() -> Iterator[tuple[int, int, int]]:
            for batch in batches:
                for doc, t in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                    for k, size in enumerate(pieces(len(encode(t)) if t else 0, capacity)):
                        yield doc, k, size

        yield from _pack(sized(), Packer(capacity, open_bins, f"0-{task}"), task, False)

    def meeting(number: int, last: bool):
        def meet(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
            packer = Packer(capacity, open_bins, f"{number}-{key[0]}")
            return pd.concat(list(_pack(_first_and_rest([left], packer), packer, int(key[0]), last)))

        return meet

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    left = materialise(rows.mapInPandas(first, PACKED))
    if not rounds:
        return left.select("doc_id", "piece_no", "n_tokens", "container_id")
    out, number = left.where("closed"), 0
    left = left.where("NOT closed")
    tasks = 1 + (left.agg(F.max("task")).first()[0] or 0)
    while tasks > 1:
        # a group is at most FAN_IN times open_bins bins
        number, tasks = number + 1, -(-tasks // FAN_IN)
        met = left.groupBy((F.col("task") / FAN_IN).cast("int").alias("group")).applyInPandas(meeting(number, tasks == 1), PACKED)
        met = materialise(met)
        out = out.unionByName(met.where("closed"))
        left = met.where("NOT closed")
    return out.unionByName(left).select("doc_id", "piece_no", "n_tokens", "container_id")
