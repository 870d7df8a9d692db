"""What several operators share: ASCII folding, words, shingles, hash splits and bounded Arrow batches."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.session import cut

#: Bytes and rows of an Arrow batch (a row of more bytes is one of its own): what a worker holds does not depend on the length of texts.
BATCH_BYTES, BATCH_ROWS = 1 << 21, 2000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lower_ascii(c: Column | str) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`: the fold a row belongs to. A null id counts as the empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % mod


def words(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased, in UTF-8. bytes.lower and bytes.split keep to ASCII."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same words, as text, of a column of texts in one array, and the number of words of each text (null: none)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    void = pc.equal(flat, "")  # at the ends of texts that begin or end with white space
    if not pc.any(void).as_py():
        return flat, np.diff(ends).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(~void.to_numpy(zero_copy_only=False))))
    return flat.filter(pc.invert(void)), np.diff(before[ends])


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k neighbours of h."""
    n = max(0, len(h) - k + 1)
    with np.errstate(over="ignore"):
        s = np.full(n, np.uint64(k), dtype=np.uint64)
        for i in range(k):
            s = s * _MIX + h[i : i + n]
        s ^= s >> np.uint64(29)
        s *= _MIX
        s ^= s >> np.uint64(32)
    return s


def _distinct(s: np.ndarray) -> np.ndarray:
    """np.unique by sorting."""
    s = np.sort(s)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles; with fewer words the whole sequence is one; without words none."""
    h = word_hashes(words(text))
    return _distinct(_rolled(h, min(k, len(h)))) if len(h) else h


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over batches of bounded size. Spark reads the bounds when the plan runs, so the session keeps them."""
    conf = df.sparkSession.conf
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        if not 0 < int(conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df.mapInArrow(f, schema)


def gathered(batches: Iterator[pa.RecordBatch], size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes, for work that has a cost a batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: Keys of more rows are salted, for as many keys at most (those with the most rows): what is broadcast has a fixed bound.
HOT_ROWS, HOT_KEYS = 200, 10_000


def spread(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner", by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """rows joined with groups, which has one row a key and its number of rows in the column `size`. A key with more than
    HOT_ROWS rows is dealt to salts, and its group to each of them, so that no task gets a hot key as a whole. by: the columns
    that tell a key's rows apart (all others by default). most: the most rows of a key, where that is known."""
    if ((groups.agg(F.max(size)).first()[0] or 0) if most is None else most) <= HOT_ROWS:
        return rows.join(groups, keys, how)
    hot = cut(groups.where(F.col(size) > HOT_ROWS).orderBy(F.desc(size), *keys).limit(HOT_KEYS).select(*keys, F.ceil(F.col(size) / HOT_ROWS).cast("int").alias("__salts")))
    others = by or [c for c in rows.columns if c not in keys]
    salt = F.coalesce(F.pmod(F.xxhash64(*others), F.col("__salts")).cast("int"), F.lit(0)).alias("__salt")
    dealt = rows.join(F.broadcast(hot), keys, "left").select(*rows.columns, salt)
    copies = groups.join(F.broadcast(hot), keys, "left").select(*groups.columns, F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)).alias("__salt"))
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, with what it takes in front that no column of df is called so, in any spelling."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n = f"_{n}"
        taken.add(n)
        out.append(n)
    return out
