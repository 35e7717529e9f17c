"""Token counts as delta-maintained rollups.

A batch of changes (insert, revise, delete) becomes signed rows per document: what it takes back
and what it adds. Their sums by source, language and tokenizer version are appended; totals are
the sums over committed batches and never look at a text or document again. A batch is written
under its identifier and counts only once its commit mark stands, which is put last: a job that
is lost half way is run again under the same identifier, and a batch that is committed already is
left alone.

Only log rows of documents that a batch names are added up, behind a semi-join on its ids. Sums are
partial before the shuffle, so a source with a third of all rows is one row a task.

Very long texts are encoded whole. Runs of a thousand or more blanks or line ends are cut out first, by
the rule that the pattern itself follows, and merged on their own: the pattern's look-ahead would
overflow its stack in a run of a million.

Awkward input: a null text has no tokens, a null source or language is a group of its own. Rows
with a null id are one document without a name. A repeated change counts once; of different
changes of one document and tokenizer in a batch a delete wins, else the largest count. Inserting
a document that is there revises it; deleting or revising one that is not there takes back
nothing. An empty batch commits and changes nothing, an empty table has no counts. Further columns of
``changes`` are not read; those of ``docs`` pass through ``count_tokens``, but for its own two names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortrail.llm.shared import text_batches, tidy
from cohortrail.llm.textscan import slices
from cohortrail.sources.store import path_exists

# Fixed value: the pattern that cuts a text before byte pairs are merged.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# The characters that the pattern's \\s stands for.
_BLANK = "\t\n\v\f\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_BLANK}]{{1000,}}")
#: A vocabulary file larger than this is refused: it is broadcast.
MOST_BYTES = 64 << 20


@lru_cache(maxsize=4)
def _encoding(name: str, vocabulary: bytes) -> tiktoken.Encoding:
    lines = (line.split() for line in vocabulary.splitlines() if line)
    ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(encoding: tiktoken.Encoding, text: str) -> int:
    """Tokens of a text. A long run of blanks is one piece without its last character, which goes to
    what follows; at the end of the text it is one piece."""
    total, at = 0, 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()]))
        total += len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:] if at else text))


def count_tokens(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """``docs`` with n_tokens of each whole ``text`` under the vocabulary ``tokenizer`` in
    ``folder``; the text goes."""
    path = Path(folder) / f"{tokenizer}.tiktoken"
    if path.stat().st_size > MOST_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    spark = docs.sparkSession
    text_batches(spark)
    vocabulary = spark.sparkContext.broadcast(path.read_bytes())
    docs = docs.drop("n_tokens", "tokenizer")
    rest = [f.name for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields
                       if f.name != "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer, vocabulary.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                n = [n_tokens(encoding, t) if t else 0 for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in rest] + [pa.array(n, pa.int64())],
                    names=[*rest, "n_tokens"],
                )

    counted = docs.select(*rest, "text").mapInArrow(tidy(scan), f"{schema}, n_tokens bigint")
    return counted.withColumn("tokenizer", F.lit(tokenizer))


KEYS = ["source", "lang", "tokenizer"]
LOG = "doc_id bigint, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


class TokenRollup:
    """Rollups under a folder that all executors share: ``log``, ``sums`` and ``commits``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def is_committed(self, batch: str) -> bool:
        return path_exists(self.spark, f"{self.folder}/commits/{batch}")

    def _batches(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        return sorted(status.getPath().getName() for status in files.listStatus(path))

    def _read(self, kind: str, schema: str) -> DataFrame:
        """The rows of committed batches only."""
        paths = [f"{self.folder}/{kind}/{batch}" for batch in self._batches()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def documents(self, named: DataFrame | None = None) -> DataFrame:
        """The present counts per document and tokenizer; of those in ``named`` (id, t) only."""
        log = self._read("log", LOG)
        if named is not None:
            same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("tokenizer").eqNullSafe(F.col("t"))
            log = log.join(named, same, "left_semi")
        return (
            log.groupBy("doc_id", *KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs > 0")
        )

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens over committed batches; groups without a
        document are left out."""
        return (
            self._read("sums", LOG.partition(", ")[2])
            .groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs > 0")
        )

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, source, lang, tokenizer, n_tokens, change) as one batch;
        false if it was committed before."""
        if self.is_committed(batch):
            return False
        last = F.max(F.struct((F.col("change") == "delete").alias("gone"), "n_tokens", *KEYS[:2]))
        changes = (
            changes.select(F.col("doc_id").cast("bigint").alias("doc_id"), *KEYS, "n_tokens", "change")
            .groupBy("doc_id", "tokenizer")
            .agg(last.alias("x"))
        )
        added = changes.where("not x.gone").select(
            "doc_id", "x.source", "x.lang", "tokenizer",
            F.lit(1).cast("bigint").alias("n_docs"),
            F.coalesce("x.n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"),
        )
        signed = added
        if self._batches():
            named = changes.select(F.col("doc_id").alias("id"), F.col("tokenizer").alias("t"))
            taken = self.documents(named).select(
                "doc_id", *KEYS, (-F.col("n_docs")).alias("n_docs"),
                (-F.col("n_tokens")).alias("n_tokens"),
            )
            signed = added.unionByName(taken)
        log = f"{self.folder}/log/{batch}"
        signed.write.mode("overwrite").parquet(log)
        (
            self.spark.read.schema(LOG)
            .parquet(log)
            .groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .write.mode("overwrite")
            .parquet(f"{self.folder}/sums/{batch}")
        )
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/{batch}")
        files = mark.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.createNewFile(mark)
