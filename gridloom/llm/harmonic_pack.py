"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: documents longer than C/(j+1) and no longer than C/j go
j to a bin, whatever their order, so each worker fills bins of fixed counts on its own and nothing
is exchanged. Documents longer than C give up whole bins first.

What such a bin lacks is filled up with pieces of other documents. As few as can be are cut for that: the longest,
which would leave the widest gaps themselves, and just as many as hold the ids that the bins of all others lack. So most documents
stay whole, and bins come out full. What a worker has left in the end becomes sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.fast_tokens import word_tokens
from gridloom.llm.hashed import blocks, trimmed
from gridloom.storage import ship

CAPACITY = 4096
END_ID = 2
#: Bytes of text that a worker takes apart at once, about.
BLOCK_BYTES = 2 << 20
#: Of a piece: its row, ids before it in the document, its length, the document's ids, and where its own lie.
_FIELDS = ("row", "start", "length", "total", "at")


def _order(rows: dict[str, np.ndarray], by: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[by] for k, v in rows.items()}


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


class _Packer:
    """Bins of one worker. A sequence's id holds the partition and the bin's number."""

    def __init__(self, partition: int, capacity: int) -> None:
        self.first, self.capacity, self.bins = partition << 40, capacity, 0
        self.waiting = {k: np.empty(0, np.int64) for k in _FIELDS}
        self.ids = np.empty(0, np.uint32)

    def _sequences(self, n: int) -> np.ndarray:
        self.bins += n
        return self.first + np.arange(self.bins - n, self.bins)

    def add(self, rows: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        """Pieces and places of the bins that are full, with the documents ``rows`` of ``sizes`` ids, which follow each other in ``ids``."""
        c, ends = self.capacity, np.cumsum(sizes)
        whole, rest = sizes // c, sizes % c
        n = int(whole.sum())
        doc = np.repeat(np.arange(len(sizes)), whole)
        start = (np.arange(n) - np.repeat(np.cumsum(whole) - whole, whole)) * c
        shift = len(self.ids)
        full = {"row": rows[doc], "start": start, "length": np.full(n, c), "total": sizes[doc], "at": shift + (ends - sizes)[doc] + start, "sequence": self._sequences(n), "offset": np.zeros(n, np.int64)}
        left = np.flatnonzero(rest)
        new = {"row": rows[left], "start": (whole * c)[left], "length": rest[left], "total": sizes[left], "at": shift + (ends - rest)[left]}
        self.ids = np.concatenate([self.ids, ids])
        pieces = _joined([self.waiting, new])
        pieces = _order(pieces, np.argsort(-pieces["length"], kind="stable"))
        fillers = self._fillers(pieces["length"])
        binned, gaps, late = self._bins(_order(pieces, np.arange(fillers, len(pieces["row"]))))
        filled, rest_of = self._fill(_order(pieces, np.arange(fillers)), gaps)
        out = _joined([full, binned, filled])
        out["crc"] = self._checks(out)
        self._keep(_joined([rest_of, late]))
        return out

    def _fillers(self, length: np.ndarray) -> int:
        """How many of the pieces, longest first, hold what bins of all the others lack."""
        lacks = self.capacity / (self.capacity // length) - length if len(length) else np.empty(0)
        have, want = np.cumsum(length), lacks.sum() - np.cumsum(lacks)
        return int(np.searchsorted(have - want, 0.0)) + 1 if len(length) else 0

    def _bins(self, pieces: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], dict[str, np.ndarray]]:
        """(places of pieces in bins of fixed counts, the bins' gaps, pieces that wait)."""
        count = self.capacity // pieces["length"]
        nothing = {k: np.empty(0, np.int64) for k in (*_FIELDS, "sequence", "offset")}
        binned, gaps, late = [nothing], [_order({"sequence": np.empty(0, np.int64), "offset": np.empty(0, np.int64)}, np.arange(0))], []
        for j in np.unique(count).tolist():
            mine = np.flatnonzero(count == j)
            bins = len(mine) // j
            late.append(mine[bins * j :])
            if not bins:
                continue
            own = _order(pieces, mine[: bins * j])
            ends = np.cumsum(own["length"].reshape(bins, j), axis=1)
            sequence = self._sequences(bins)
            binned.append(own | {"sequence": np.repeat(sequence, j), "offset": ends.ravel() - own["length"]})
            gaps.append({"sequence": sequence, "offset": ends[:, -1]})
        return _joined(binned), _joined(gaps), _order(pieces, np.concatenate(late) if late else np.empty(0, np.int64))

    def _fill(self, fillers: dict[str, np.ndarray], gaps: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """(pieces of ``fillers`` in the gaps, what is left of them)."""
        have, want = np.cumsum(fillers["length"]), np.cumsum(self.capacity - gaps["offset"])
        most = int(min(have[-1] if len(have) else 0, want[-1] if len(want) else 0))
        cuts = np.unique(np.concatenate([[0, most], have[have < most], want[want < most]]))
        begin, length = cuts[:-1], np.diff(cuts)
        doc, gap = np.searchsorted(have, begin, "right"), np.searchsorted(want, begin, "right")
        inside = begin - (have - fillers["length"])[doc] if len(begin) else begin
        filled = {"row": fillers["row"][doc], "start": fillers["start"][doc] + inside, "length": length, "total": fillers["total"][doc], "at": fillers["at"][doc] + inside}
        filled |= {"sequence": gaps["sequence"][gap], "offset": self.capacity - (want[gap] - begin)}
        used = np.clip(most - (have - fillers["length"]), 0, fillers["length"])
        rest = {"row": fillers["row"], "start": fillers["start"] + used, "length": fillers["length"] - used, "total": fillers["total"], "at": fillers["at"] + used}
        return filled, _order(rest, np.flatnonzero(rest["length"]))

    def _checks(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        raw = memoryview(self.ids.astype("<u4").tobytes())
        return np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(rows["at"].tolist(), rows["length"].tolist(), strict=True)), np.int64, len(rows["at"]))

    def _keep(self, pieces: dict[str, np.ndarray]) -> None:
        ends = np.cumsum(pieces["length"])
        begin = ends - pieces["length"]
        at = np.repeat(pieces["at"] - begin, pieces["length"]) + np.arange(int(ends[-1]) if len(ends) else 0)
        self.ids, self.waiting = self.ids[at], pieces | {"at": begin}

    def finish(self) -> dict[str, np.ndarray]:
        """What is left, in full sequences and sequences of powers of two."""
        total, sizes = len(self.ids), []
        sizes += [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if total % self.capacity >> b & 1]
        kept, self.capacity = self.capacity, max(sizes, default=1)
        gaps = {"sequence": self._sequences(len(sizes)), "offset": self.capacity - np.array(sizes, np.int64)}
        out, _ = self._fill(self.waiting, gaps)
        # sequences start at 0, whatever their size
        out["offset"] = out["offset"] - (gaps["offset"][out["sequence"] - gaps["sequence"][0]] if len(sizes) else 0)
        self.capacity = kept
        return out | {"crc": self._checks(out)}


def _pack(path: str, capacity: int, end_id: int, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        packer = _Packer(TaskContext.get().partitionId(), capacity)
        seen: dict[int, object] = {}  # ids of rows that wait for their bins
        number, type_ = 0, pa.int64()

        def named(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            names = pa.array([seen[r] for r in rows["row"].tolist()], type_)
            values = [pa.array(rows[k].astype(np.int64)) for k in ("start", "length", "crc", "total", "sequence", "offset")]
            return pa.RecordBatch.from_arrays([names, *values], [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for part in (b.slice(i, n) for b in batches for i, n in blocks(b.column(1), BLOCK_BYTES)):
            type_ = part.column(0).type
            flat, bounds = tokens.encode(part.column(1))
            # the end id follows each document
            sizes = np.diff(bounds) + 1
            ids = np.full(int(sizes.sum()), end_id, np.uint32)
            mask = np.ones(len(ids), bool)
            mask[np.cumsum(sizes) - 1] = False
            ids[mask] = flat
            seen |= enumerate(part.column(0).to_pylist(), number)
            yield named(packer.add(np.arange(number, number + part.num_rows), sizes.astype(np.int64), ids))
            number += part.num_rows
            waits = set(packer.waiting["row"].tolist())
            seen = {r: v for r, v in seen.items() if r in waits}
        if number:
            yield named(packer.finish())

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id") -> DataFrame:
    """Pieces of the documents (``id_column``, text) and their places in sequences of ``capacity`` ids.

    ``tokenizer`` is the path of a tokenizers file, there on every executor; special tokens are not
    added, then ``end_id`` follows each document. A null or empty text is its end id alone. Rows
    are packed as they come, repeated or with null ids too. Each id lies in exactly one piece.
    Empty input gives no rows. A worker holds one block of texts, per class fewer pieces than fill a bin, and the documents
    that are being cut up. ``capacity`` is a power of two. Columns beyond the two are not looked at.
    """
    ship(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_column]
    narrow = docs.select(id_column, F.col("text").cast("string").alias("text"))
    fields = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return narrow.mapInArrow(trimmed(_pack(tokenizer, capacity, end_id, id_column)), f"{id_column} {id_type}, {fields}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_harmonic_pack(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
