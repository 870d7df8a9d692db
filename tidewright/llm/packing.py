"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Documents are tokenised and only those above the capacity are cut. Pieces that fill a sequence are emitted at once. The
others are dealt to partitions by hash and packed there, longest first, each into the fullest bin that it fits; nearly
full bins are emitted. The underfull bins then are items themselves: fewer and fewer partitions (a tree of FAN_IN) pack
them again until one is left or a round merges nothing. A task never gets more than about TASK_ITEMS pieces: while more
are left, more partitions stay. Every round is kept in the shared folder and its order is total, so a task that runs again
packs the same way.

Tokens: words are encoded once and remembered (a bounded memo). Texts of ASCII and Latin letters are split into words by
an equivalent of the tokenizer's own pattern and encoded by a second library under the same merges; all other texts, and
those that may hold the name of a special token, go through the tokenizer itself.

Defined results: a null or empty text is the end token alone; repeated rows are packed once each; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import map_batches
from tidewright.session import cut
from tidewright.sources import table

NAME = "op3_packing"
CAPACITY = 2048
END_ID = 0
TASK_ITEMS = 200_000
FAN_IN = 8
NEARLY = 0.98
MEMO = 400_000
_LETTERS = "a-zß-öø-ÿœ"
#: The tokenizer's pattern, for texts without characters that _OTHER finds.
_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_OTHER = re.compile(r"<\||[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿœŒ]")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_signs() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts as little-endian 32-bit integers."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        model = json.load(open(path))["model"]
        signs, mark = _byte_signs(), b"\x01"
        special = set(self.own.get_added_tokens_decoder())
        pieces = {i: (bytes(signs[c] for c in t.removesuffix("</w>")) + (mark if t.endswith("</w>") else b"")) for t, i in model["vocab"].items() if i not in special}
        # a last byte joins its end mark before all other merges; the others follow in the vocabulary's order
        first = sorted(pieces, key=lambda i: (len(pieces[i]) > 2 or pieces[i][1:] != mark, len(pieces[i]) > 1, i))
        self.ids = np.array(first, dtype="<u4")
        # the end mark of a word made of that mark alone stands for it; texts with it are never sent here
        self.fast = tiktoken.Encoding("words", pat_str="[^\x01]+\x01", mergeable_ranks={pieces[i]: r for r, i in enumerate(first)}, special_tokens={})
        self.ends = np.array([len(pieces[i]) > 1 and pieces[i].endswith(mark) for i in first])
        self.memo: dict[str, bytes] = {}

    def _learn(self, fresh: list[str]) -> None:
        found = [_PATTERN.findall(w) for w in fresh]
        flat = [x for f in found for x in f]
        ranks = np.array(self.fast.encode_ordinary("\x01".join(flat) + "\x01") if flat else [], dtype=np.int64)
        bounds = np.concatenate(([0], np.flatnonzero(self.ends[ranks]) + 1)) if len(ranks) else np.zeros(1, dtype=np.int64)
        assert len(bounds) == len(flat) + 1
        ids, at = self.ids[ranks], 0
        for w, f in zip(fresh, found, strict=True):
            self.memo[w] = ids[bounds[at] : bounds[at + len(f)]].tobytes()
            at += len(f)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        split = [t.lower().split() if t and not _OTHER.search(t) else None for t in texts]
        for i in range(0, len(split), 50):
            part = split[i : i + 50]
            memo = self.memo
            fresh = list({w for x in part if x for w in x if w not in memo})
            if len(self.memo) + len(fresh) > MEMO:
                memo.clear()
                fresh = list({w for x in part if x for w in x})
            if fresh:
                self._learn(fresh)
            for t, x in zip(texts[i : i + 50], part, strict=True):
                if x is not None:
                    out.append(b"".join(map(self.memo.__getitem__, x)))
                elif not t:
                    out.append(b"")
                else:
                    out.append(np.array(self.own.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes())
        return out


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), _ENCODERS[tokenizer].encode(b.column(1).to_pylist()), strict=True):
                ids += end
                rows += [(doc, k, at // 4, len(x) // 4, zlib.crc32(x)) for k, at in enumerate(range(0, len(ids), 4 * capacity)) for x in [ids[at : at + 4 * capacity]]]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, _PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best fit in the given order: the bin and the offset of each item, and the number of bins. A bit per free size finds the fullest fitting bin at once."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, bins = 0, 0
    where, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for i, size in enumerate(sizes.tolist()):
        if fits := bits >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                bits ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - room
        if left := room - size:
            free[left].append(b)
            bits |= 1 << left
    return where, offset, bins


def _round(level: int, capacity: int):
    """Packs the bins of a partition as items. Rows: pieces with bin and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        bin_, length, offset = (t[c].to_numpy() for c in ("bin", "length", "offset"))
        keys, item = np.unique(bin_, return_inverse=True)
        fill = np.bincount(item, weights=length).astype(np.int64)
        order = np.lexsort((keys, -fill))
        where, at, n = best_fit(fill[order], capacity)
        to, shift = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        to[order], shift[order] = where, at
        total = np.bincount(to, weights=fill, minlength=n)
        base = (level << 52) + (TaskContext.get().partitionId() << 32)
        cols = {c: t[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        cols |= {"bin": pa.array(base + to[item]), "offset": pa.array(offset + shift[item]), "closed": pa.array(total[to[item]] >= NEARLY * capacity), "merged": pa.array(np.full(t.num_rows, n < len(keys)))}
        for x in pa.table(cols).to_batches(max_chunksize=50_000):
            yield x

    return run


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset."""
    found = cut(found.withColumn("bin", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))
    out = [found.where(F.col("length") >= capacity).withColumn("sequence_id", F.col("bin") * 2 + 1)]
    left = found.where(F.col("length") < capacity)
    n = left.count()
    parts, level = max(1, math.ceil(n / TASK_ITEMS)), 1
    while n:
        dealt = left.select("doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset").repartition(parts, F.xxhash64("bin"))
        packed = cut(dealt.mapInArrow(_round(level, capacity), f"{_PIECES}, bin long, offset long, closed boolean, merged boolean"))
        done = packed.where("closed").withColumn("sequence_id", F.col("bin") * 2)
        left = packed.where("not closed")
        seen = left.agg(F.count("*").alias("n"), F.max("merged").alias("merged")).first()
        if parts == 1 or not seen.n or (level > 1 and not seen.merged):
            out += [packed.withColumn("sequence_id", F.col("bin") * 2)]
            break
        out.append(done)
        n, level = seen.n, level + 1
        parts = max(1, math.ceil(parts / FAN_IN), math.ceil(n / TASK_ITEMS))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = out[0].select(*names)
    for x in out[1:]:
        whole = whole.unionByName(x.select(*names))
    return whole


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return pack(pieces(table(spark, folder, "documents").select("doc_id", "text"), default_tokenizer()))
