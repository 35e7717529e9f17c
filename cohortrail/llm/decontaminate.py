"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item is short and a document may be very long, so their Jaccard similarity says nothing. Items
are therefore partitioned by size, into classes of up to B shingles for powers of two B, and for
each class a document is seen through windows of 2B shingle positions, one every B positions: a
passage of up to B positions lies within one window whatever its place. Window and item are then
of comparable size, the containment threshold turns into a Jaccard threshold, and bands and rows
are chosen for it. Minima are computed once per smallest block; those of larger blocks and of
windows are minima of minima. Every candidate is verified on exact shingle containment between
the whole item and the whole document.

Words are runs of ASCII letters and digits and of characters beyond ASCII, so punctuation and
layout do not hide a passage; ASCII capitals count as small letters. A shingle is ``width`` words. An
item of fewer words is one n-gram of its own length, and is contained wherever its words follow each
other, so a benchmark of single common words is in most documents.

Documents are only scanned: nothing is shuffled, whatever passage many of them share. Items are
broadcast in blocks of about ``block_bytes`` of text, one scan for each block. With more than one, a
block's findings are written before the next is indexed, so memory holds one block at a time.

Awkward input: an item without words is never found, a document without words contains nothing.
Repeated items (same id and text) count once; repeated documents and null ids are reported row by
row. An empty table on either side gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortrail.llm.places import choose, in_files, place
from cohortrail.llm.shared import Store, text_batches, tidy
from cohortrail.llm.textscan import ALNUM, mix, shingle_hashes, slices, word_hashes


@dataclass(frozen=True)
class ContainmentParams:
    width: int = 5
    percent: int = 80
    functions: int = 64
    #: A class whose chance to miss an item at the threshold is above this looks up all of the
    #: item's shingles instead of its minima.
    miss: float = 1e-5
    #: Text of the items that one scan of the documents looks for.
    block_bytes: int = 8 << 20


def _multipliers(functions: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(functions, dtype=np.uint64)
    return mix(seeds, 301) | np.uint64(1), mix(seeds, 302)


def minima(values: np.ndarray, starts: np.ndarray, functions: int) -> np.ndarray:
    """The least value of each hash function over the run of values from each start."""
    out = np.empty((len(starts), functions), dtype=np.uint64)
    if len(starts):
        for k, (a, b) in enumerate(zip(*_multipliers(functions), strict=True)):
            h = values * a + b
            out[:, k] = np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts)
    return out


def choose_bands(similarity: float, functions: int, miss: float) -> tuple[int, int] | None:
    """The most rows per band, and their bands, that miss this similarity rarely enough."""
    for rows in range(functions, 0, -1):
        bands = functions // rows
        if (1 - similarity**rows) ** bands <= miss:
            return bands, rows
    return None


def _bands(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(sketch), 1))
    for k in range(rows):
        keys = mix(keys ^ sketch[:, k : bands * rows : rows], 303)
    return keys


class ItemIndex:
    """The items of one block: their shingle sets, and per size class the keys to look up."""

    def __init__(self, ids: list, texts: list, params: ContainmentParams):
        words, counts, _ = word_hashes(pa.array(texts, pa.large_string()), ALNUM)
        values, n = shingle_hashes(words, counts, params.width)
        ends = np.cumsum(n)
        self.ids = np.array(ids, dtype=object)
        self.sets = [np.unique(values[e - k : e]) for e, k in zip(ends, n, strict=True)]
        # Items shorter than a shingle are looked up as n-grams of their own length.
        self.short: dict[int, tuple] = {}
        first = np.cumsum(counts) - counts
        for size in range(1, params.width):
            items = np.flatnonzero(counts == size)
            if len(items):
                own = words[(first[items, None] + np.arange(size)).ravel()]
                grams, _ = shingle_hashes(own, np.full(len(items), size), size)
                self.short[size] = self._table(grams[:, None], items)
        n = np.where(counts < params.width, 0, n)
        self.params = params
        self.direct: tuple[np.ndarray, np.ndarray] = self._table([], [])
        self.classes: dict[int, tuple] = {}
        sizes: dict[int, list[int]] = {}
        for item, k in enumerate(n.tolist()):
            if k:
                sizes.setdefault(1 << max(0, (k - 1).bit_length()), []).append(item)
        looked_up = []
        for size, items in sorted(sizes.items()):
            share = params.percent / 100
            for_item = {}
            for item in items:
                q = len(self.sets[item])
                similarity = share * q / (2 * size + q - share * q)
                for_item[item] = choose_bands(similarity, params.functions, params.miss)
            looked_up += [i for i in items if for_item[i] is None]
            items = [i for i in items if for_item[i] is not None]
            if items:
                bands, rows = max((for_item[i] for i in items), key=lambda x: x[0])
                flat = np.concatenate([self.sets[i] for i in items])
                starts = np.cumsum([0, *(len(self.sets[i]) for i in items[:-1])])
                keys = _bands(minima(flat, starts, params.functions), bands, rows)
                self.classes[size] = (bands, rows, *self._table(keys, items))
        if looked_up:
            self.direct = self._table([self.sets[i] for i in looked_up], looked_up)

    @staticmethod
    def _table(keys, items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, the item of each, and which leading 16 bits occur."""
        flat = np.concatenate([np.asarray(k) for k in keys]) if len(keys) else np.zeros(0, "u8")
        owner = np.repeat(np.array(items, dtype=np.int64), [len(k) for k in keys])
        order = np.argsort(flat, kind="stable")
        seen = np.zeros(1 << 16, dtype=bool)
        seen[flat >> np.uint64(48)] = True
        return flat[order], owner[order], seen

    @staticmethod
    def _hits(keys: np.ndarray, rows: np.ndarray, table: tuple) -> np.ndarray:
        """(row, item) pairs whose keys meet; ``rows`` names the document of each key."""
        sorted_keys, owner, seen = table
        near = np.flatnonzero(seen[keys >> np.uint64(48)])
        keys, rows = keys[near], rows[near]
        begin = np.searchsorted(sorted_keys, keys, "left")
        length = np.searchsorted(sorted_keys, keys, "right") - begin
        at = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
        return np.stack([np.repeat(rows, length), owner[at]], axis=1)

    def search(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of every item contained in a text."""
        words, counts, _ = word_hashes(texts, ALNUM)
        values, n = shingle_hashes(words, counts, self.params.width)
        if not len(values):
            return []
        row_of = np.repeat(np.arange(len(n)), n)
        pairs = [self._hits(values, row_of, self.direct)] if len(self.direct[0]) else []
        block, sketch, row = 0, None, None
        for size in sorted(self.classes):
            if sketch is None:
                blocks = -(-n // size)
                row = np.repeat(np.arange(len(n)), blocks)
                place = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                starts = np.repeat(np.cumsum(n) - n, blocks) + place * size
                sketch, block = minima(values, starts, self.params.functions), size
            while block < size:
                place = np.arange(len(row)) - np.searchsorted(row, row, "left")
                even = np.flatnonzero(place % 2 == 0)
                sketch, row, block = np.minimum.reduceat(sketch, even, axis=0), row[even], block * 2
            bands, rows, *table = self.classes[size]
            window = sketch.copy()
            joined = np.flatnonzero(row[1:] == row[:-1])
            window[joined] = np.minimum(sketch[joined], sketch[joined + 1])
            keys = _bands(window, bands, rows)
            pairs.append(self._hits(keys.ravel(), np.repeat(row, bands), tuple(table)))
        found = self._search_short(words, counts)
        if not pairs:
            return found
        at, own = -1, None
        ends = np.cumsum(n)
        for r, item in np.unique(np.concatenate(pairs), axis=0).tolist():
            if r != at:
                at, own = r, np.unique(values[ends[r] - n[r] : ends[r]])
            wanted = self.sets[item]
            place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            shared = int((own[place] == wanted).sum())
            if 100 * shared >= self.params.percent * len(wanted):
                found.append((r, item, shared))
        return found

    def _search_short(self, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
        """Items of fewer words than a shingle, wherever their words follow each other in a text."""
        found = []
        for size, table in self.short.items():
            grams, n = shingle_hashes(words, counts, size, whole_if_short=False)
            pairs = self._hits(grams, np.repeat(np.arange(len(n)), n), table)
            found += [(r, item, 1) for r, item in np.unique(pairs, axis=0).tolist()]
        return found


def _item_blocks(items: DataFrame, params: ContainmentParams) -> tuple[DataFrame, int]:
    """Distinct items (item_id, text, block) and the number of blocks, each of about
    ``block_bytes`` of text."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // params.block_bytes))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return items.withColumn("block", number), blocks


def _shared_index(items: DataFrame, block: int, params: ContainmentParams) -> Broadcast:
    own = items.where(F.col("block") == block).toPandas()
    ids = [None if i is None or i != i else int(i) for i in own["item_id"].tolist()]
    return items.sparkSession.sparkContext.broadcast(
        ItemIndex(ids, own["text"].tolist(), params)
    )


def _block_by_block(
    search: Callable[[Broadcast], DataFrame],
    items: DataFrame,
    blocks: int,
    params: ContainmentParams,
    store: Store,
) -> DataFrame:
    """What ``search`` finds with each block's index. A block's rows are written before the next
    one is read, so that no more than one index is held, however many items there are."""
    found = []
    for k in range(blocks):
        index = _shared_index(items, k, params)
        found.append(store.keep(search(index)))
        index.destroy()
    return reduce(DataFrame.unionByName, found)


def contained_items(
    docs: DataFrame, items: DataFrame, params: ContainmentParams | None = None
) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared, containment) for every item (item_id, text) of
    which a document (doc_id, text) holds at least ``percent`` per cent of the shingles."""
    params = params or ContainmentParams()
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items, blocks = _item_blocks(items, params)
    if blocks == 1:
        return _found(docs, _shared_index(items, 0, params))
    store = Store(docs.sparkSession, "contained")
    return _block_by_block(partial(_found, docs), items, blocks, params, store)


def _found(docs: DataFrame, index: Broadcast) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = index.value
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                found = look.search(batch.column("text"))
                size = [len(look.sets[item]) for _, item, _ in found]
                shared = [s for _, _, s in found]
                rows = pa.array([r for r, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        pa.array([look.ids[item] for _, item, _ in found], pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(shared, pa.int64()),
                        pa.array([a / b for a, b in zip(shared, size, strict=True)], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "n_item", "n_shared", "containment"],
                )

    return docs.mapInArrow(
        tidy(scan), "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint, containment double"
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, params: ContainmentParams | None = None
) -> DataFrame:
    """The rows of ``docs``, with all columns, that contain no item."""
    params = params or ContainmentParams()
    text_batches(docs.sparkSession)
    items, blocks = _item_blocks(items, params)
    if blocks == 1:
        return _without(docs, _shared_index(items, 0, params))
    store = Store(docs.sparkSession, "contaminated")
    docs = in_files(docs, store)
    texts = docs.select("text", *place(docs))
    gone = _block_by_block(partial(_places, texts), items, blocks, params, store)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return choose(docs.select(whole, *place(docs)), gone, store, inside=False).select("row.*")


def _places(texts: DataFrame, index: Broadcast) -> DataFrame:
    """Places (file, position) of the texts that contain an item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                rows = sorted({r for r, _, _ in index.value.search(batch.column("text"))})
                yield batch.select(["file", "position"]).take(pa.array(rows, pa.int64()))

    return texts.mapInArrow(tidy(scan), "file string, position bigint")


def _without(docs: DataFrame, index: Broadcast) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[r for r, _, _ in index.value.search(batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

    return docs.mapInArrow(tidy(scan), docs.schema)
