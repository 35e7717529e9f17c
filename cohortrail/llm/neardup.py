"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document is the set of its distinct word shingles. Documents with equal sets form a class by a
128-bit fingerprint of the whole set; only one representative of a class goes on. Its sketch has
one value per coordinate: in round i every shingle is hashed to one coordinate, with values that
are larger than those of all rounds before, until every coordinate is filled; after as many
rounds as coordinates, each further round offers all shingles to one coordinate, so filling is
certain. Bands of coordinates are bucketed, and links are confirmed on full sets.

Nothing depends on the size of a group. Each document is first held against the smallest ones of
the buckets that it shares most of. What these links leave apart within a bucket is compared in
full: in small buckets pair by pair, in large ones blocks of documents outside the largest component
against blocks of all whose sizes are near theirs, by their rarest shingles. A link is lost only if no band agrees, with a probability of
6e-7 at the threshold.

Awkward input: a null or empty text, or one without words, has an empty set and links with
nothing. A text with fewer words than the shingle width is one shingle. A row with a null id is
returned with a null component and kept. Rows that repeat an id are each returned with the
component of their text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortrail.llm.components import connected_components
from cohortrail.llm.places import choose, in_files, place
from cohortrail.llm.shared import Store, tidy
from cohortrail.llm.textscan import (
    SPACED,
    distinct_per_row,
    mix,
    row_sums,
    shingle_hashes,
    slices,
    word_hashes,
)


@dataclass(frozen=True)
class NearDupParams:
    """Shingle width in words, the similarity as a percentage, and bands times rows of a sketch."""

    width: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    #: Buckets up to this size compare pair by pair, larger ones in blocks of so many shingles.
    small_bucket: int = 64
    block_shingles: int = 1 << 19
    #: How many bucket heads a document is first held against.
    heads: int = 2

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


_EMPTY = np.uint64((1 << 64) - 1)


def similarity_sketch(values: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """A row of ``coordinates`` values per non-empty set; empty sets stay unfilled."""
    rows, t = len(counts), coordinates
    sketch = np.full(rows * t, _EMPTY)
    row = np.repeat(np.arange(rows), counts)
    open_rows = counts > 0
    for i in range(2 * t):
        if not len(values):
            break
        h = mix(values, 1000 + i)
        value = (h & np.uint64((1 << 48) - 1)) | np.uint64(i << 48)
        if i < t:
            at = (((h >> np.uint64(48)) * np.uint64(t)) >> np.uint64(16)).astype(np.int64)
        else:
            at = i - t
        np.minimum.at(sketch, row * t + at, value)
        still = np.flatnonzero(open_rows)
        full = (sketch.reshape(rows, t)[still] != _EMPTY).all(axis=1)
        if full.any():
            open_rows[still[full]] = False
            stay = open_rows[row]
            values, row = values[stay], row[stay]
    return sketch.reshape(rows, t)


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band; the number of the band is part of it."""
    parts = sketch.reshape(len(sketch), bands, -1)
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(sketch), 1))
    for k in range(parts.shape[2]):
        keys = mix(keys ^ parts[:, :, k], 77)
    return keys


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    words, counts, _ = word_hashes(batch.column("text"), SPACED)
    return distinct_per_row(*shingle_hashes(words, counts, width))


SKETCH = (
    "doc_id bigint, file string, position bigint, "
    "n_shingles bigint, print_a bigint, print_b bigint, bands array<bigint>"
)
SKETCH_NAMES = ["doc_id", "file", "position", "n_shingles", "print_a", "print_b", "bands"]


def sketches(docs: DataFrame, params: NearDupParams) -> DataFrame:
    """Size, fingerprint and band keys of every document (doc_id, text, file, position)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                values, counts = _sets(batch, params.width)
                keys = band_keys(
                    similarity_sketch(values, counts, params.coordinates), params.bands
                )
                offsets = np.arange(len(counts) + 1) * params.bands
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("file"),
                        batch.column("position"),
                        pa.array(counts.astype(np.int64)),
                        pa.array(row_sums(mix(values, 5), counts).view(np.int64)),
                        pa.array(row_sums(mix(values, 6), counts).view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(offsets, pa.int32()), pa.array(keys.ravel().view(np.int64))
                        ),
                    ],
                    names=SKETCH_NAMES,
                )

    return docs.mapInArrow(tidy(scan), SKETCH)


def _partner_sets(
    docs: DataFrame, places: DataFrame, params: NearDupParams, store: Store
) -> DataFrame:
    """The full sets, as sorted 64-bit hashes, of the documents at ``places``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                values, counts = _sets(batch, params.width)
                offsets = np.concatenate([[0], np.cumsum(counts)]) * 8
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.LargeBinaryArray.from_buffers(
                            pa.large_binary(),
                            len(counts),
                            [
                                None,
                                pa.py_buffer(offsets.astype(np.int64)),
                                pa.py_buffer(values.tobytes()),
                            ],
                        ).cast(pa.binary()),
                    ],
                    names=["node", "shingles"],
                )

    def sets(chosen: DataFrame) -> DataFrame:
        return chosen.select("doc_id", "text").mapInArrow(
            tidy(scan), "node bigint, shingles binary"
        )

    return choose(docs, places, store, inside=True, then=sets)


def _close(shared: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                a = np.frombuffer(batch["set_a"][k].as_buffer(), np.uint64)
                b = np.frombuffer(batch["set_b"][k].as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep[k] = 100 * shared >= percent * (len(both) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "set_a", "set_b")
        .mapInArrow(tidy(scan), "a bigint, b bigint")
    )


def _sizes_allow(percent: int):
    """Only sets whose sizes are this near can be similar."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _pairs_of_small_buckets(members: DataFrame, percent: int) -> DataFrame:
    a = members.select(
        "key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a")
    )
    b = members.select(
        "key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b")
    )
    return (
        a.join(b, "key")
        .where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & _sizes_allow(percent))
        .select("a", "b")
        .distinct()
    )


def _size_blocks(
    inside: DataFrame, params: NearDupParams, store: Store
) -> tuple[DataFrame, DataFrame]:
    """Blocks of the members (cluster, n, asks) of clusters: of every size n, and the pairs to compare.

    A block takes consecutive sizes until it holds about ``block_shingles`` shingles; one that
    holds more, since many sets are of one size, is compared in parts. A pair of blocks is
    compared if one of them asks and sets of their sizes can be similar.
    """
    by_size = inside.groupBy("cluster", "n").agg(
        (F.col("n") * F.count("*")).alias("volume"),
        (F.col("n") * F.count_if("asks")).alias("asked"),
    )
    smaller = Window.partitionBy("cluster").orderBy("n").rowsBetween(
        Window.unboundedPreceding, -1
    )
    below = F.coalesce(F.sum("volume").over(smaller), F.lit(0))
    of_size = store.keep(
        by_size.withColumn("block", F.floor(below / params.block_shingles).cast("int"))
    )
    blocks = store.keep(
        of_size.groupBy("cluster", "block").agg(
            F.min("n").alias("low"),
            F.max("n").alias("high"),
            F.ceil(F.sum("volume") / params.block_shingles).cast("int").alias("parts"),
            F.ceil(F.sum("asked") / params.block_shingles).cast("int").alias("asking"),
        )
    )
    held = blocks.select("cluster", "block", "parts", F.col("low").alias("a"), F.col("high").alias("b"))
    asking = blocks.where("asking > 0").select(
        "cluster", F.col("block").alias("query_block"), "asking", "low", "high"
    )
    similar = (100 * F.col("b") >= params.percent * F.col("low")) & (
        100 * F.col("high") >= params.percent * F.col("a")
    )
    pairs = held.join(asking, "cluster").where(similar)
    return (
        of_size.select("cluster", "n", "block"),
        store.keep(pairs.select("cluster", "block", "parts", "query_block", "asking")),
    )


def _hits(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of runs of ``length`` from ``begin``."""
    return np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())


def _links_of_large_buckets(
    members: DataFrame, sets: DataFrame, params: NearDupParams, store: Store
) -> DataFrame:
    """Links between different components of documents that meet in large buckets.

    Buckets that share documents form a cluster, so that a document counts once and not once a
    band. Within it, blocks of documents outside the largest component meet the blocks of all
    whose sizes are near theirs.
    """
    heads = members.groupBy("key").agg(F.min("node").alias("a"))
    edges = members.join(heads, "key").select("a", F.col("node").alias("b"))
    clusters = connected_components(edges, store).withColumnRenamed("component", "cluster")
    inside = store.keep(
        members.select("node", "n", "component").distinct().join(clusters, "node")
    )
    by_component = inside.groupBy("cluster", "component").agg(F.count("*").alias("size"))
    largest = by_component.groupBy("cluster").agg(
        F.max(F.struct("size", F.negative("component").alias("minus"))).alias("top"),
        F.count("*").alias("components"),
    )
    largest = largest.where("components > 1").select("cluster", F.negative("top.minus").alias("largest"))
    inside = store.keep(
        inside.join(largest, "cluster").select(
            "cluster", "node", "component", "n", (F.col("component") != F.col("largest")).alias("asks")
        )
    )
    of_size, pairs = _size_blocks(inside, params, store)
    placed = store.keep(inside.join(of_size, ["cluster", "n"]))
    hashed = F.xxhash64("node")
    held_side = placed.join(pairs, ["cluster", "block"]).select(
        "cluster", "node", "component", "n", "block", "query_block",
        F.pmod(hashed, F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("query_part"),
        F.lit(False).alias("asks"),
    )
    asking_side = (
        placed.where("asks")
        .withColumnRenamed("block", "query_block")
        .join(pairs, ["cluster", "query_block"])
        .select(
            "cluster", "node", "component", "n", "block", "query_block",
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
            F.pmod(hashed, F.col("asking")).cast("int").alias("query_part"),
            F.lit(True).alias("asks"),
        )
    )

    def compare(unit: pd.DataFrame) -> pd.DataFrame:
        held = unit[~unit["asks"]]
        node, component = held["node"].to_numpy(), held["component"].to_numpy()
        size = held["n"].to_numpy()
        values = [np.frombuffer(x, np.uint64) for x in held["shingles"]]
        owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
        values = np.concatenate(values) if values else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        a, b = [], []
        asking = unit[unit["asks"]]
        for x, c, own in zip(
            asking["node"], asking["component"], asking["shingles"], strict=True
        ):
            own = np.frombuffer(own, np.uint64)
            begin = np.searchsorted(values, own, side="left")
            length = np.searchsorted(values, own, side="right") - begin
            # A similar set lacks few of these shingles, so it has one of any few and one more:
            # those that are rarest here give all candidates.
            few = len(own) + 1 + (-len(own) * params.percent) // 100
            rarest = np.argpartition(length, few - 1)[:few]
            near = np.unique(owner[_hits(begin[rarest], length[rarest])])
            near = near[component[near] != c]
            if not len(near):
                continue
            shared = np.bincount(owner[_hits(begin, length)], minlength=len(node))[near]
            linked = near[_close(shared, len(own), size[near], params.percent)]
            _, first = np.unique(component[linked], return_index=True)
            b += node[linked[first]].tolist()
            a += [x] * len(first)
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return (
        held_side.unionByName(asking_side)
        .join(sets, "node")
        .groupBy("cluster", "block", "part", "query_block", "query_part")
        .applyInPandas(compare, "a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame, params: NearDupParams | None = None, store: Store | None = None
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Components are those of the links whose sets have at least ``percent`` per cent of their
    union in common; the component's id is its smallest document, which alone is kept.
    """
    return placed_duplicates(docs, params, store).drop("file", "position")


def placed_duplicates(
    docs: DataFrame, params: NearDupParams | None = None, store: Store | None = None
) -> DataFrame:
    """``near_duplicates`` with the place (file, position) of each row."""
    params = params or NearDupParams()
    store = store or Store(docs.sparkSession, "neardup")
    docs = in_files(docs, store)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *place(docs))
    prints = ["n_shingles", "print_a", "print_b"]
    scanned = store.keep(sketches(docs, params))
    linkable = scanned.where("n_shingles > 0 and doc_id is not null")
    classes = store.keep(
        linkable.groupBy(*prints)
        .agg(
            F.min(F.struct("doc_id", "file", "position")).alias("first"),
            F.first("bands").alias("bands"),
        )
        .select(*prints, F.col("first.doc_id").alias("node"), "first.file", "first.position", "bands")
    )

    banded = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    heads = store.keep(
        banded.groupBy("key")
        .agg(F.count("*").alias("size"), F.min("node").alias("head"))
        .where("size > 1")
    )
    members = store.keep(banded.join(heads, "key"))
    partners = classes.join(members.select("node").distinct(), "node", "left_semi")
    sets = store.keep(_partner_sets(docs, partners.select("file", "position"), params, store))

    by_agreement = Window.partitionBy("b").orderBy(F.desc("agreeing"), "a")
    first_pairs = store.keep(
        members.where("node <> head")
        .groupBy(F.col("head").alias("a"), F.col("node").alias("b"))
        .agg(F.count("*").alias("agreeing"))
        .withColumn("place", F.row_number().over(by_agreement))
        .where(F.col("place") <= params.heads)
        .select("a", "b")
    )
    links = store.keep(_confirm(first_pairs, sets, params.percent))
    found = connected_components(links, store)

    placed = members.join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    placed = store.keep(placed)
    apart = (
        placed.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("key")
    )
    open_members = store.keep(placed.join(apart, "key"))
    small = _pairs_of_small_buckets(
        open_members.where(F.col("size") <= params.small_bucket), params.percent
    ).join(first_pairs, ["a", "b"], "left_anti")
    links = links.unionByName(_confirm(small, sets, params.percent))
    large = open_members.where(F.col("size") > params.small_bucket)
    if not large.isEmpty():
        links = links.unionByName(_links_of_large_buckets(large, sets, params, store))
    final = connected_components(links, store)

    classes = store.keep(
        classes.select("node", *prints)
        .join(final, "node", "left")
        .select(*prints, F.coalesce("component", "node").alias("component"))
    )
    return (
        scanned.drop("bands")
        .join(classes, prints, "left")
        .select(
            "doc_id",
            "file",
            "position",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias(
                "component_id"
            ),
        )
        .withColumn(
            "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
        )
    )
