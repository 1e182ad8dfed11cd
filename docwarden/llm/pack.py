"""Packing of token sequences into bins: best fit, then swap-based local search on the sum of squared fills.

Pieces are packed where they are read, in blocks, without a shuffle. Only bins that are left underfull travel: they
meet in fewer blocks and are packed once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import blocks, written
from docwarden.llm.tokens import encoder

BLOCK_PIECES = 16_384
BLOCK_BYTES = 32 << 20
#: Bins less full than this are packed again, together with those of other blocks.
UNDERFULL = 0.98
PIECES = "id long, piece int, start long, length int, ids binary"
PACKED = PIECES + ", sequence_id long, offset int, fill int"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: items over half a bin cannot share one, and small ones must fit beside them or elsewhere."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    sums = counts * np.arange(capacity + 1)
    n, s = np.append(counts.cumsum(), len(lengths)), sums.cumsum()
    half, best = capacity // 2, 0
    for k in range(half + 1):
        alone = len(lengths) - n[capacity - k]
        large = n[capacity - k] - n[half]
        room = large * capacity - (s[capacity - k] - s[half])
        small = s[half] - (s[k - 1] if k else 0)
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return int(best)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # a bit for each room that some bin has
    bins: list[list[int]] = []
    size = lengths.tolist()
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = size[item]
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        if room > need:
            by_room[room - need].append(b)
            rooms |= 1 << (room - need)
    return bins


def _sums(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different sums of one or two of ``sizes``, each with the numbers of the sizes it is made of (the same twice for one)."""
    i, j = np.triu_indices(len(sizes))
    sums, first = np.unique(np.where(i == j, sizes[i], sizes[i] + sizes[j]), return_index=True)
    return sums, i[first], j[first]


class _OpenBins:
    """Sizes of the items of underfull bins, in order of bin and size, for finding the best exchange of a sum by bisection."""

    def __init__(self, bins: dict[int, list[int]], fill: np.ndarray, lengths: np.ndarray, capacity: int):
        self.fill, self.lengths, self.capacity, self.stride = fill, lengths, capacity, capacity + 1
        # A size of 0 in every bin stands for giving nothing back, and the last key is above all.
        self.keys = np.concatenate([*(self._own(b, bins[b]) for b in sorted(bins)), [len(fill) * self.stride + 2 * self.stride]])

    def _own(self, b: int, items: list[int]) -> np.ndarray:
        return b * self.stride + np.sort(np.append(self.lengths[items], 0))

    def changed(self, b: int, items: list[int]) -> None:
        low, high = np.searchsorted(self.keys, [b * self.stride, (b + 1) * self.stride])
        self.keys = np.concatenate([self.keys[:low], self._own(b, items), self.keys[high:]])

    def gains(self, sums: np.ndarray, source_fill: np.ndarray | int, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each sum and target the rise of the squared fills by its best exchange (0: none), and the size given back.

        The more a target gets, the higher the rise: the best size is the smallest that leaves room.
        """
        fill = self.fill[targets]
        low = np.maximum(sums[:, None] - (self.capacity - fill), 0)
        size = self.keys[np.searchsorted(self.keys, targets * self.stride + low)] - targets * self.stride
        moved = sums[:, None] - size
        rise = 2 * moved * (fill - np.reshape(source_fill, (-1, 1)) + moved)
        return np.where((moved > 0) & (rise > 0), rise, 0), size


#: Sums times targets that are looked at in one numpy call; it bounds memory.
LOOK = 1 << 20


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, bound: int) -> list[list[int]]:
    """Exchanges between underfull bins, each raising the sum of squared fills, until bins are emptied or none is left.

    Of an underfull bin, emptiest first, one or two items are moved to another bin, or exchanged for one that is smaller than they are.
    The search ends at ``bound`` bins, or when no such bin, nor any that could be spared, has an exchange left. A bin without one is
    looked at again only if a bin that changed since has one to offer.
    """
    fill = np.array([int(lengths[b].sum()) for b in bins])
    held = {i: list(b) for i, b in enumerate(bins) if fill[i] < capacity}
    if len(bins) <= bound or len(held) < 2:
        return bins
    ids = np.array(sorted(held))
    index = _OpenBins(held, fill, lengths, capacity)
    stuck = np.zeros(len(bins), bool)
    offers: dict[int, np.ndarray] = {}
    n_bins = len(bins)
    while n_bins > bound:
        left = ids[fill[ids] > 0]
        left = left[np.argsort(fill[left], kind="stable")]
        sources = left[: max(n_bins - bound, int((fill[left] < UNDERFULL * capacity).sum()))]
        free = sources[~stuck[sources]]
        if not len(free):
            break
        a = int(free[0])
        sums, first, second = _sums(lengths[held[a]])
        targets = left[(left != a) & (fill[left] < capacity)]
        best = (0, 0, 0, 0)
        for at in range(0, len(sums), max(1, LOOK // max(1, len(targets)))):
            rise, size = index.gains(sums[at : at + max(1, LOOK // max(1, len(targets)))], fill[a], targets)
            k = int(rise.argmax()) if rise.size else 0
            if rise.size and rise.flat[k] > best[0]:
                i, j = divmod(k, len(targets))
                best = (int(rise.flat[k]), at + i, int(targets[j]), int(size.flat[k]))
        if not best[0]:
            stuck[a], offers[a] = True, sums
            continue
        _, i, b, back = best
        out = [held[a][k] for k in {int(first[i]), int(second[i])}]
        home = next((x for x in held[b] if lengths[x] == back), None) if back else None
        held[a] = [x for x in held[a] if x not in out] + ([] if home is None else [home])
        held[b] = [x for x in held[b] if x != home] + out
        moved = int(sums[i]) - back
        fill[a] -= moved
        fill[b] += moved
        n_bins -= int(fill[a] == 0)
        index.changed(a, held[a])
        index.changed(b, held[b])
        stuck[b] = False
        waiting = np.flatnonzero(stuck)
        changed = np.array([c for c in (a, b) if 0 < fill[c] < capacity])
        if len(waiting) and len(changed):
            sizes = [len(offers[w]) for w in waiting.tolist()]
            rise, _ = index.gains(np.concatenate([offers[w] for w in waiting.tolist()]), np.repeat(fill[waiting], sizes), changed)
            stuck[np.repeat(waiting, sizes)[rise.any(1)]] = False
    return [b for i, b in enumerate(bins) if i not in held] + [b for b in held.values() if b]


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Item numbers of each bin, as few bins as found. Lengths are from 1 to ``capacity``."""
    if not len(lengths):
        return []
    bins = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    return bins if len(bins) == bound else local_search(bins, lengths, capacity, bound)


def pieces(path: str, capacity: int, end_id: int):
    """Each document's ids and an end id, cut into pieces of ``capacity`` ids from its end; the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch["id"].to_pylist()
            rows: list[tuple] = []
            held = 0
            for doc, data in zip(ids, encoder(path)(batch["text"]), strict=True):
                data += last
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    to = n - (n - at - 1) // capacity * capacity
                    rows.append((doc, k, at, to - at, data[4 * at : 4 * to]))
                    at, k = to, k + 1
                held += len(data)
                if held > BLOCK_BYTES // 4:
                    yield _batch(rows, PIECES_ARROW)
                    rows, held = [], 0
            yield _batch(rows, PIECES_ARROW)
        encoder(path).rest()

    return cut


PIECES_ARROW = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary())])
PACKED_ARROW = pa.schema([*PIECES_ARROW, ("sequence_id", pa.int64()), ("offset", pa.int32()), ("fill", pa.int32())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pack_blocks(capacity: int, again: bool):
    """Packs what streams by in blocks of bounded rows and bytes; ``again``: bins that do not get fewer stay as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32) + (int(again) << 62)

        def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = pa.Table.from_batches(held).combine_chunks()
            lengths = rows["length"].to_numpy().astype(np.int64)
            bins = pack(lengths, capacity)
            if again and len(bins) >= len(np.unique(rows["sequence_id"].to_numpy())):
                yield from rows.to_batches()
                return
            order = np.array([x for b in bins for x in b], np.int64)
            ids = np.repeat(np.arange(len(bins)), [len(b) for b in bins]) + number
            number += len(bins)
            offset = np.concatenate([np.cumsum(lengths[b]) - lengths[b] for b in bins])
            fill = np.repeat([int(lengths[b].sum()) for b in bins], [len(b) for b in bins])
            rows = rows.select(PIECES_ARROW.names).take(pa.array(order))
            for name, values, kind in (("sequence_id", ids, pa.int64()), ("offset", offset, pa.int32()), ("fill", fill, pa.int32())):
                rows = rows.append_column(name, pa.array(values, kind))
            yield from rows.to_batches(max_chunksize=4096)

        held, n, size, last = [], 0, 0, None
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                if (n + part.num_rows > BLOCK_PIECES or size > BLOCK_BYTES) and held:
                    # Bins that come again come together; a block does not end inside one.
                    if not again or part["sequence_id"][0].as_py() != last:
                        yield from packed(held)
                        held, n, size = [], 0, 0
                held.append(part)
                n, size = n + part.num_rows, size + 4 * int(np.sum(part["length"].to_numpy()))
                last = part["sequence_id"][part.num_rows - 1].as_py() if again else None
        if n:
            yield from packed(held)

    return run


def pack_documents(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``sequence_id``, ``offset``: one row per piece.

    Pieces of a sequence lie from offset 0 on without gaps, ``capacity`` ids at most. Only longer documents are cut.
    Null and empty texts are the end id alone. Null and repeated ids are carried along, each row packed for itself;
    an empty table gives no rows; other columns are ignored.
    """
    cut, packed = pieces(path, capacity, end_id), _pack_blocks(capacity, False)
    first = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = written(first.mapInArrow(lambda batches: packed(cut(batches)), PACKED), "packed")
    full = F.col("fill") >= int(UNDERFULL * capacity)
    left = first.where(~full)
    n = blocks(left.count(), BLOCK_PIECES)
    second = left.repartition(n, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(_pack_blocks(capacity, True), PACKED)
    return first.where(full).union(second).drop("fill")
