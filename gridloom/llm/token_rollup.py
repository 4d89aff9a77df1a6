"""Token counts as delta-maintained rollups.

A change feed holds signed changes of documents: inserts (+), deletes (-) and revised counts, which are the
old count taken back and the new one added. A batch of changes is reduced to one additive delta per
source, language and tokenizer version, written below its batch id; totals are sums of the deltas
of all committed batches. No document-level state is kept or read.

A batch is written below an attempt's own name and committed by renaming that folder to the batch's, which fails if it is there:
a batch that was committed before is not applied again, whatever it holds, of two writers of one batch one wins, and one whose
writer was lost leaves an attempt that nothing reads. Compaction folds the batches of one listing into a base that holds
their ids and totals, committed in the same way; purging removes what the base holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.fast_tokens import word_tokens
from gridloom.llm.hashed import blocks
from gridloom.llm.words import n_words
from gridloom.storage import scratch, ship

KEYS = ("source", "lang", "tokenizer")


def changes(rows: DataFrame) -> DataFrame:
    """Signed rows (source, lang, tokenizer, docs, tokens) of ``rows`` (op, source, lang, tokenizer, tokens, old_tokens, old_source, old_lang, old_tokenizer).

    ``op`` is insert, delete or revise. Only revise looks at the old_* columns: what the document was counted as.
    Null counts are zero; rows with another or a null op change nothing.
    """
    new = F.struct(F.lit(1).alias("sign"), *KEYS, F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    gone = F.struct(F.lit(-1).alias("sign"), *KEYS, F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    old = F.struct(F.lit(-1).alias("sign"), *[F.col(f"old_{k}").alias(k) for k in KEYS], F.coalesce("old_tokens", F.lit(0)).cast("long").alias("tokens"))
    signed = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(gone)).when(F.col("op") == "revise", F.array(old, new))
    rows = rows.select(F.explode(signed).alias("c")).select("c.*")
    return rows.select(*KEYS, F.col("sign").cast("long").alias("docs"), (F.col("sign") * F.col("tokens")).alias("tokens"))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for part in (b.slice(i, n) for b in batches for i, n in blocks(b.column(b.num_columns - 1))):
            _, bounds = tokens.encode(part.column(part.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(bounds).astype(np.int64))], [*part.schema.names[:-1], "tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, carry: list[str]) -> DataFrame:
    """Columns ``carry`` of ``docs`` (which has text) with ``tokens``, the ids that the tokenizers file at path ``tokenizer`` cuts the text into.

    No special tokens; null text has none. The file is there on every executor.
    """
    ship(docs.sparkSession)
    rows = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(_counted(tokenizer), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", tokens long")


class Rollup:
    """Totals in ``folder``, one table of deltas per committed batch."""

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        fs = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path())) if fs.exists(self._path()) else []

    def _rename(self, attempt: str, name: str) -> bool:
        """False if there is a ``name`` already."""
        jvm = self.spark.sparkContext._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.valueOf("NONE")
        fs = self._fs()
        whole = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            whole.rename(fs.makeQualified(self._path(attempt)), fs.makeQualified(self._path(name)), how)
        except Exception:
            if fs.exists(self._path(name)):
                fs.delete(self._path(attempt), True)
                return False
            raise
        return True

    def _listing(self) -> tuple[str | None, list[str]]:
        """(the last base, names of the batches that it does not hold), of one listing."""
        names = self._names()
        base = max((n for n in names if n.startswith("base=")), default=None)
        batches = [n for n in names if n.startswith("batch=")]
        if base and batches:  # batches that are not purged yet
            live = self.spark.createDataFrame([(n,) for n in batches], "name string")
            batches = sorted(r[0] for r in live.join(self._ids(base), "name", "left_anti").collect())
        return base, batches

    def _ids(self, base: str) -> DataFrame:
        return self.spark.read.schema("name string").parquet(f"{self.folder}/{base}/ids")

    def _sums(self, base: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{b}" for b in batches] + ([f"{self.folder}/{base}/totals"] if base else [])
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def is_committed(self, batch_id: str) -> bool:
        name, names = f"batch={quote(batch_id, safe='')}", self._names()
        base = max((n for n in names if n.startswith("base=")), default=None)
        return name in names or base is not None and not self._ids(base).where(F.col("name") == name).isEmpty()

    def live(self) -> list[str]:
        """Ids of the committed batches that no base holds."""
        return [unquote(n.removeprefix("batch=")) for n in self._listing()[1]]

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Apply a batch of :func:`changes` rows; False if it was committed before. It is looked up again after the
        write, as a base may have taken it in and been purged meanwhile."""
        if self.is_committed(batch_id):
            return False
        attempt = f"attempt={uuid.uuid4().hex}"
        delta = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.write.parquet(f"{self.folder}/{attempt}")
        if self.is_committed(batch_id):
            self._fs().delete(self._path(attempt), True)
            return False
        return self._rename(attempt, f"batch={quote(batch_id, safe='')}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens of all committed batches; keys with neither docs nor tokens are left out."""
        return self._sums(*self._listing())

    def compact(self) -> bool:
        """Fold the committed batches of one listing into a new base; False if another compaction came first."""
        return self._fold(*self._listing())

    def _fold(self, base: str | None, batches: list[str]) -> bool:
        attempt, number = f"attempt={uuid.uuid4().hex}", int((base or "base=0").split("=")[1]) + 1
        self._sums(base, batches).coalesce(1).write.parquet(f"{self.folder}/{attempt}/totals")
        ids = self.spark.createDataFrame([(n,) for n in batches], "name string")
        (ids.unionByName(self._ids(base)) if base else ids).coalesce(1).write.parquet(f"{self.folder}/{attempt}/ids")
        return self._rename(attempt, f"base={number:08d}")

    def purge(self) -> None:
        """Delete the batches that the last base holds and the bases before it; who still reads those must be done."""
        base, live = self._listing()
        if base:
            for n in self._names():
                if n.startswith("base=") and n < base or n.startswith("batch=") and n not in live and not self._ids(base).where(F.col("name") == n).isEmpty():
                    self._fs().delete(self._path(n), True)


#: Tokenizer versions of the query: white-space words, and runs of letters or digits with single other signs.
VERSIONS = ("words-1", "pieces-2")
_PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a change feed: all inserted as words-1; those of id 3 modulo 7 deleted again; the
    rest of even id revised to pieces-2. The first batch is sent twice, and the feed compacted on the way."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = docs.select("doc_id", "source", "lang", F.lit(VERSIONS[0]).alias("tokenizer"), n_words(F.col("text")).alias("tokens"), "text")
    none = {f"old_{k}": F.lit(None).cast("string") for k in KEYS} | {"old_tokens": F.lit(None).cast("long")}
    gone = F.coalesce(F.col("doc_id") % 7 == 3, F.lit(False))
    insert = base.withColumns({"op": F.lit("insert")} | none)
    delete = base.where(gone).withColumns({"op": F.lit("delete")} | none)
    again = base.where(~gone & (F.col("doc_id") % 2 == 0)).withColumns({"op": F.lit("revise"), "old_source": F.col("source"), "old_lang": F.col("lang"), "old_tokenizer": F.col("tokenizer"), "old_tokens": F.col("tokens")})
    again = again.withColumns({"tokenizer": F.lit(VERSIONS[1]), "tokens": F.coalesce(F.regexp_count("text", F.lit(_PIECE)), F.lit(0)).cast("long")})
    rollup = Rollup(spark, scratch(spark, "rollup"))
    rollup.commit("0001", changes(insert))
    rollup.commit("0002", changes(delete))
    rollup.compact()
    rollup.purge()
    rollup.commit("0001", changes(insert))
    rollup.commit("0003", changes(again))
    return rollup.totals()


OP1_SQL = r"""
WITH counted AS (
  SELECT source, lang,
    CASE WHEN doc_id % 2 = 0 THEN 'pieces-2' ELSE 'words-1' END AS tokenizer,
    CASE WHEN doc_id % 2 = 0
      THEN len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]'))
      ELSE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) END AS n
  FROM documents WHERE doc_id % 7 <> 3)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens
FROM counted GROUP BY source, lang, tokenizer
"""
