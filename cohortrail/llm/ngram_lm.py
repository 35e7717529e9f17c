"""N-gram scoring of texts by deleted interpolation.

P(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1), with weights that depend on how often the
context v was seen (buckets by powers of two). They are learned by expectation-maximisation on
counts of a deleted part of the training texts, against maximum-likelihood estimates of the rest;
scores then use the counts of all training texts.

Texts are packed once into compressed chunks of some megabytes. Each chunk asks for the counts of
its distinct unigrams and bigrams: their 64-bit hashes and own counts go, sorted and packed, to
buckets of the hash range, where they are added up, and the sums come back to the chunk in the
order asked for. So a key crosses the network once a chunk and not once an occurrence, a very
frequent key is no larger than a rare one, and neither counts nor texts pass the driver. Chunks
have bounded size, and the number of buckets follows the volume of text.

For the weights, the deleted part reports a histogram over (context bucket, ratio of the bigram
estimate to the uniform one, the same of the unigram estimate), with ratios on a logarithmic grid
of a tenth. Its cells are bounded by the grid, whatever the corpus.

Awkward input: a null text is empty; an empty text is one end token. Rows with a null id are
training texts and are scored. Repeated rows count and are scored each. Without training texts,
counts are zero and every token has the uniform probability 1. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrail.llm.shared import Store, tidy
from cohortrail.llm.textscan import SPACED, mix, row_sums, slices, word_hashes


@dataclass(frozen=True)
class LmParams:
    #: Bytes of text in a chunk, and of text whose keys one bucket adds up.
    chunk_bytes: int = 4 << 20
    bucket_bytes: int = 4 << 20
    iterations: int = 200
    grid: float = 0.1
    #: Least weight of the uniform part, so that no token is impossible.
    least_uniform: float = 1e-6
    context_buckets: int = 48


RETAINED, DELETED, UNSEEN = 0, 1, 2
_END = np.uint64(0x1F0E3DAD99908345)
_START = np.uint64(0xF7177163C833DFF4)
_NONE = -32768


def held_out(doc_id: str = "doc_id") -> Column:
    """A fixed seventh of the documents, by id, that is not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def part_of(doc_id: str = "doc_id") -> Column:
    """Held-out documents, the deleted sixth of the training documents, and the rest."""
    rest = F.crc32(F.col(doc_id).cast("string")) % 7
    return (
        F.when(rest == 2, UNSEEN).when(rest == 3, DELETED).otherwise(RETAINED).cast("int")
    )


CHUNK = (
    "chunk string, part int, n_docs bigint, n_tokens bigint, n_bytes bigint, "
    "doc_ids array<bigint>, body binary"
)


def _chunks(docs: DataFrame, params: LmParams) -> DataFrame:
    """Texts of (doc_id, text, part) packed by part; a longer text is a chunk of its own."""

    def pack(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        texts = table.column("text").combine_chunks().cast(pa.large_string()).fill_null("")
        _, counts, _ = word_hashes(texts, SPACED)
        body = pa.BufferOutputStream()
        with pa.ipc.new_stream(
            body,
            pa.schema([("text", pa.large_string())]),
            options=pa.ipc.IpcWriteOptions(compression="zstd"),
        ) as writer:
            writer.write_batch(pa.record_batch([texts], names=["text"]))
        ids = table.column("doc_id").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().hex]),
                pa.array([part], pa.int32()),
                pa.array([len(texts)], pa.int64()),
                pa.array([int(counts.sum()) + len(texts)], pa.int64()),
                pa.array([table.column("text").nbytes], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([body.getvalue().to_pybytes()], pa.binary()),
            ],
            names=[x.split()[0] for x in CHUNK.split(", ")],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        for whole in batches:
            for part in (RETAINED, DELETED, UNSEEN):
                mine = whole.filter(pa.compute.equal(whole.column("part"), part))
                for batch in slices(mine, "text", params.chunk_bytes):
                    n = batch.column("text").nbytes
                    if held.get(part) and size[part] + n > params.chunk_bytes:
                        yield pack(part, held.pop(part))
                        size[part] = 0
                    held.setdefault(part, []).append(batch.select(["doc_id", "text"]))
                    size[part] = size.get(part, 0) + n
        for part, rest in held.items():
            yield pack(part, rest)

    return docs.mapInArrow(tidy(scan), CHUNK)


class ChunkTokens:
    """The tokens of a chunk as positions in its sorted list of distinct keys.

    A key is the hash of a unigram with the lowest bit set, or of a bigram with it cleared.
    """

    def __init__(self, body: bytes):
        texts = pa.ipc.open_stream(body).read_all().column("text").combine_chunks()
        words, counts, _ = word_hashes(texts, SPACED)
        self.counts = counts + 1
        ends = np.cumsum(counts)
        tokens = np.insert(words, ends, _END)
        self.first = np.cumsum(self.counts) - self.counts
        context = np.empty_like(tokens)
        context[1:] = tokens[:-1]
        context[self.first] = _START
        one = np.uint64(1)
        unigrams = mix(tokens, 401) | one
        bigrams = mix(mix(context, 402) ^ tokens, 403) & ~one
        del words, context, tokens
        n = len(unigrams)
        both = np.concatenate([unigrams, bigrams])
        del unigrams, bigrams
        self.keys, place, self.n = np.unique(both, return_inverse=True, return_counts=True)
        del both
        self.unigram, self.bigram = place[:n], place[n:]

    def contexts(self, counts: np.ndarray, n_docs: int) -> np.ndarray:
        """How often each token's context was seen; a text's start as often as there are texts."""
        out = np.empty(len(self.unigram), dtype=np.int64)
        out[1:] = counts[self.unigram[:-1]]
        out[self.first] = n_docs
        return out


def _bucket_spans(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The buckets that sorted keys fall in, and the span of keys of each.

    A key's bucket is key * buckets / 2**64, in two halves so that nothing overflows; the work
    follows the keys and not the number of buckets.
    """
    n, half = np.uint64(buckets), np.uint64(32)
    low = keys & np.uint64((1 << 32) - 1)
    bucket = ((keys >> half) * n + ((low * n) >> half)) >> half
    starts = np.flatnonzero(np.diff(bucket, prepend=n))
    stops = np.append(starts, len(keys))[1:]
    return bucket[starts].astype(np.int32), list(zip(starts.tolist(), stops.tolist(), strict=True))


REQUEST = "bucket int, chunk string, part int, keys binary, counts binary"


def _requests(chunks: DataFrame, buckets: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tokens = ChunkTokens(batch["body"][k].as_py())
                there, spans = _bucket_spans(tokens.keys, buckets)
                counts = tokens.n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(there, pa.int32()),
                        pa.array([batch["chunk"][k].as_py()] * len(there)),
                        pa.array([batch["part"][k].as_py()] * len(there), pa.int32()),
                        pa.array([_packed_keys(tokens.keys[a:b]) for a, b in spans], pa.binary()),
                        pa.array([_packed(counts[a:b]) for a, b in spans], pa.binary()),
                    ],
                    names=["bucket", "chunk", "part", "keys", "counts"],
                )

    return chunks.select("chunk", "part", "body").mapInArrow(tidy(scan), REQUEST)


def _compressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _decompressed(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return b""
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)


def _planes(values: np.ndarray) -> bytes:
    return _compressed(values.view(np.uint8).reshape(-1, 8).T.tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_decompressed(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def _packed(values: np.ndarray) -> bytes:
    """Counts in 64 bits, byte by byte: the high bytes are mostly zero."""
    return _planes(values.astype(np.int64))


def _unpacked(data: bytes) -> np.ndarray:
    return _from_planes(data).view(np.int64)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their gaps, byte by byte: the high bytes of gaps are mostly zero."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data), dtype=np.uint64)


RESPONSE = "chunk string, bucket int, kept binary, gone binary, types bigint, kept_types bigint"


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Add up the counts of a bucket's keys, and give each chunk those that it asked for."""
    keys = [_unpacked_keys(x) for x in group["keys"]]
    sizes = np.array([len(k) for k in keys])
    own = np.concatenate([_unpacked(x) for x in group["counts"]])
    part = np.repeat(group["part"].to_numpy(), sizes)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    kept = np.bincount(place, weights=own * (part == RETAINED), minlength=len(distinct))
    gone = np.bincount(place, weights=own * (part == DELETED), minlength=len(distinct))
    kept, gone = kept.astype(np.int64), gone.astype(np.int64)
    unigram = (distinct & np.uint64(1)) == 1
    ends = np.cumsum(sizes)
    spans = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
    out = pd.DataFrame(
        {
            "chunk": group["chunk"],
            "bucket": group["bucket"],
            "kept": [_packed(kept[place[a:b]]) for a, b in spans],
            "gone": [_packed(gone[place[a:b]]) for a, b in spans],
            "types": 0,
            "kept_types": 0,
        }
    )
    # The numbers of distinct training tokens ride on one row of the bucket.
    out.iloc[0, 4] = int((unigram & (kept + gone > 0)).sum())
    out.iloc[0, 5] = int((unigram & (kept > 0)).sum())
    return out


@dataclass(frozen=True)
class Totals:
    n_docs: int
    n_tokens: int
    n_types: int


def _context_bucket(counts: np.ndarray, buckets: int) -> np.ndarray:
    out = np.zeros(len(counts), dtype=np.int64)
    seen = counts > 0
    out[seen] = 1 + np.floor(np.log2(counts[seen])).astype(np.int64)
    return np.minimum(out, buckets - 1)


def _estimates(tokens: ChunkTokens, counts: np.ndarray, totals: Totals):
    """Context counts and the ratios of both estimates to the uniform one."""
    context = tokens.contexts(counts, totals.n_docs)
    types = totals.n_types + 1
    unigram = counts[tokens.unigram] / max(totals.n_tokens, 1) * types
    bigram = counts[tokens.bigram] / np.maximum(context, 1) * types
    return context, unigram, bigram


def _column_sum(rows: DataFrame, condition: str) -> Totals:
    row = rows.where(condition).agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    return Totals(int(row[0] or 0), int(row[1] or 0), 0)


def learn_weights(cells: pd.DataFrame, params: LmParams) -> np.ndarray:
    """Weights (uniform, unigram, bigram) per context bucket, by expectation-maximisation over
    histogram cells (bucket, bigram, unigram, n). A bucket without held-out tokens takes those
    of the nearest rarer one that has some."""
    weights = np.full((params.context_buckets, 3), np.nan)
    for bucket in range(params.context_buckets):
        own = cells[cells["bucket"] == bucket]
        if own.empty:
            continue
        ratio = lambda name: np.where(
            own[name] == _NONE, 0.0, np.exp(own[name].to_numpy(float) * params.grid)
        )
        p = np.stack([np.ones(len(own)), ratio("unigram"), ratio("bigram")], axis=1)
        if bucket == 0:
            p[:, 2] = 0
        n = own["n"].to_numpy(float)[:, None]
        w = np.full(3, 1 / 3)
        for _ in range(params.iterations):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            new = (share * n).sum(axis=0) / n.sum()
            done = np.abs(new - w).max() < 1e-10
            w = new
            if done:
                break
        weights[bucket] = w
    fallback = np.array([0.5, 0.5, 0.0])
    for bucket in range(params.context_buckets):
        if np.isnan(weights[bucket, 0]):
            weights[bucket] = fallback
        if bucket == 0:
            weights[0, 2] = 0
        weights[bucket, 0] = max(weights[bucket, 0], params.least_uniform)
        weights[bucket] /= weights[bucket].sum()
        fallback = weights[bucket]
    return weights


def _with_counts(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    counts = responses.groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "kept", "gone")).alias("counts")
    )
    return chunks.join(counts, "chunk")


def _counts_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(batch["counts"][k].as_py(), key=lambda r: r["bucket"])
    return tuple(
        np.concatenate([_unpacked(r[name]) for r in rows])
        for name in ("kept", "gone")
    )


SCORED = (
    "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
    "score double"
)


def interpolated_scores(
    docs: DataFrame, params: LmParams | None = None, store: Store | None = None
) -> tuple[DataFrame, np.ndarray]:
    """Score every row of ``docs`` (doc_id, text, part) and give the learned weights.

    The result has doc_id, n_tokens, n_known (tokens seen in training), train_tokens, base_score
    (add-one unigrams) and score, both log10 probabilities of the whole text with its end.
    """
    params = params or LmParams()
    spark = docs.sparkSession
    store = store or Store(spark, "ngrams")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "part")
    chunks = store.keep(_chunks(docs, params))
    volume = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, -(-int(volume) // params.bucket_bytes))
    responses = store.keep(
        _requests(chunks, buckets).groupBy("bucket").applyInPandas(_answer, RESPONSE)
    )
    types = responses.agg(F.sum("types"), F.sum("kept_types")).first()
    training = _column_sum(chunks, f"part <> {UNSEEN}")
    retained = _column_sum(chunks, f"part = {RETAINED}")
    training = Totals(training.n_docs, training.n_tokens, int(types[0] or 0))
    retained = Totals(retained.n_docs, retained.n_tokens, int(types[1] or 0))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                kept, _ = _counts_of(batch, k)
                tokens = ChunkTokens(batch["body"][k].as_py())
                context, unigram, bigram = _estimates(tokens, kept, retained)
                cells = [_context_bucket(context, params.context_buckets)]
                for ratio in (bigram, unigram):
                    step = np.full(len(ratio), _NONE, dtype=np.int64)
                    some = ratio > 0
                    step[some] = np.rint(np.log(ratio[some]) / params.grid).astype(np.int64)
                    cells.append(step)
                flat = (cells[0] << 32) + ((cells[1] + 32768) << 16) + cells[2] + 32768
                cell, n = np.unique(flat, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((cell >> 32).astype(np.int32)),
                        pa.array((((cell >> 16) & 0xFFFF) - 32768).astype(np.int32)),
                        pa.array(((cell & 0xFFFF) - 32768).astype(np.int32)),
                        pa.array(n, pa.int64()),
                    ],
                    names=["bucket", "bigram", "unigram", "n"],
                )

    cells = (
        _with_counts(chunks.where(f"part = {DELETED}"), responses)
        .select("body", "counts")
        .mapInArrow(tidy(histogram), "bucket int, bigram int, unigram int, n bigint")
        .groupBy("bucket", "bigram", "unigram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    weights = learn_weights(cells, params)
    if not training.n_tokens:
        weights[:] = (1.0, 0.0, 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                kept, gone = _counts_of(batch, k)
                tokens = ChunkTokens(batch["body"][k].as_py())
                counts = kept + gone
                context, unigram, bigram = _estimates(tokens, counts, training)
                w = weights[_context_bucket(context, params.context_buckets)]
                p = (w[:, 0] + w[:, 1] * unigram + w[:, 2] * bigram) / (training.n_types + 1)
                own = counts[tokens.unigram]
                base = (own + 1) / (training.n_tokens + training.n_types + 1)
                # Sums over each text alone, so that a text's score does not depend on its chunk.
                ids = batch["doc_ids"][k].values
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(tokens.counts, pa.int64()),
                        pa.array(
                            row_sums((own > 0).astype(np.int64), tokens.counts), pa.int64()
                        ),
                        pa.array([training.n_tokens] * len(ids), pa.int64()),
                        pa.array(np.add.reduceat(np.log10(base), tokens.first), pa.float64()),
                        pa.array(np.add.reduceat(np.log10(p), tokens.first), pa.float64()),
                    ],
                    names=[x.split()[0] for x in SCORED.split(", ")],
                )

    scored = (
        _with_counts(chunks, responses)
        .select("doc_ids", "body", "counts")
        .mapInArrow(tidy(score), SCORED)
    )
    return scored, weights
