"""Exact dedup over a cuckoo-filter index of live digests.

Each worker holds a LiveIndex: a cuckoo filter (four 16-bit fingerprints a bucket, two buckets a
digest) before buckets of whole digests. A digest that the filter doesn't know is new; a hit is
verified against the bucket of content that it points to, by digest and length, and only then counts as a copy.
When no bucket takes a fingerprint the filter doubles and is filled again from the stored keys. An index holds HELD
digests at most; a task of more passes those on and begins anew, and what was passed on twice is added up.

Defined cases: a null text is the empty text. Null ids are smaller than any other. Of rows that
repeat both id and text, one stays. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut, partitions_for, tidy
from weft.llm.groups import attach

SLOTS = 4
MAX_KICKS = 500


class CuckooFilter:
    """Set of digests with insertion, deletion and lookup; lookups may be wrong only by a hit too many."""

    def __init__(self, buckets: int = 1024) -> None:
        self.mask = buckets - 1
        if buckets & self.mask:
            raise ValueError("buckets must be a power of two")
        self.slots = array("H", bytes(2 * SLOTS * buckets))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        i = int.from_bytes(digest[2:10], "big") & self.mask
        return mark, i, self._other(i, mark)

    def _other(self, i: int, mark: int) -> int:
        return (i ^ (mark * 0x5BD1E995 >> 7)) & self.mask

    def __contains__(self, digest: bytes) -> bool:
        mark, i, j = self._places(digest)
        s = self.slots
        return mark in s[SLOTS * i : SLOTS * i + SLOTS] or mark in s[SLOTS * j : SLOTS * j + SLOTS]

    def _put(self, i: int, mark: int) -> bool:
        for at in range(SLOTS * i, SLOTS * i + SLOTS):
            if not self.slots[at]:
                self.slots[at] = mark
                return True
        return False

    def add(self, digest: bytes) -> bool:
        """False if the filter is too full; it then holds all but one fingerprint and must be built anew."""
        mark, i, j = self._places(digest)
        if self._put(i, mark) or self._put(j, mark):
            return True
        for kick in range(MAX_KICKS):
            at = SLOTS * j + kick % SLOTS
            mark, self.slots[at] = self.slots[at], mark
            j = self._other(j, mark)
            if self._put(j, mark):
                return True
        return False

    def discard(self, digest: bytes) -> bool:
        """Remove one fingerprint of a digest that was added."""
        mark, i, j = self._places(digest)
        for b in (i, j):
            for at in range(SLOTS * b, SLOTS * b + SLOTS):
                if self.slots[at] == mark:
                    self.slots[at] = 0
                    return True
        return False


class LiveIndex:
    """Live digests with their newest row and number of copies, in buckets of content behind the filter.

    A digest's entry lies in the bucket of its first place in the filter; only a hit in the filter opens that bucket,
    and only an equal digest of equal length in it is a copy.
    """

    def __init__(self, buckets: int = 1024) -> None:
        self.filter = CuckooFilter(buckets)
        self.content: dict[int, list[list]] = {}
        self.live = self.resized = 0

    def _bucket(self, digest: bytes) -> int:
        return int.from_bytes(digest[2:10], "big") & self.filter.mask

    def entries(self) -> Iterator[list]:
        """[digest, n_bytes, newest row, copies] of all live digests."""
        for bucket in self.content.values():
            yield from bucket

    def find(self, digest: bytes) -> list | None:
        """The entry of a digest, if it's live."""
        if digest not in self.filter:
            return None
        return next((e for e in self.content.get(self._bucket(digest), ()) if e[0] == digest), None)

    def add(self, digest: bytes, n_bytes: int, row: tuple, copies: int = 1) -> bool:
        """Add copies of a text; whether it was new."""
        entry = self.find(digest)
        if entry is not None:
            if entry[1] != n_bytes:
                raise ValueError("two texts of different lengths have one SHA-256 digest")
            entry[3] += copies
            if row > entry[2]:
                entry[2] = row
            return False
        self.content.setdefault(self._bucket(digest), []).append([digest, n_bytes, row, copies])
        self.live += 1
        if not self.filter.add(digest):
            self._grow()
        return True

    def remove(self, digest: bytes, copies: int = 1) -> bool:
        """Take copies away; the digest dies with its last copy. The newest row stays as it was."""
        entry = self.find(digest)
        if entry is None:
            return False
        entry[3] -= copies
        if entry[3] <= 0:
            at = self._bucket(digest)
            self.content[at].remove(entry)
            if not self.content[at]:
                del self.content[at]
            self.filter.discard(digest)
            self.live -= 1
        return True

    def _grow(self) -> None:
        """A filter of twice the buckets, filled from the stored keys, which are dealt to its buckets."""
        size, held = self.filter.mask + 1, list(self.entries())
        while True:
            size *= 2
            self.resized += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.add(e[0]) for e in held):
                break
        self.content = {}
        for e in held:
            self.content.setdefault(self._bucket(e[0]), []).append(e)


#: Digests that a task's index holds before it passes them on.
HELD = 500_000
GROUPS = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_LEAST = -(2**63)


@tidy
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of one task's rows, HELD digests at a time."""
    index = LiveIndex()

    def out() -> Iterator[pa.RecordBatch]:
        held = list(index.entries())
        for i in range(0, len(held), 50_000):
            digest, n, row, copies = zip(*held[i : i + 50_000], strict=True)
            cols = [digest, n, [r[1] if r[0] else None for r in row], [r[2] for r in row], copies]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, GROUPS.types, strict=True)], schema=GROUPS)

    for b in batches:
        for digest, n, doc, row, copies in zip(*(b.column(c).to_pylist() for c in GROUPS.names), strict=True):
            index.add(digest, n, (doc is not None, _LEAST if doc is None else doc, row), copies)
            if index.live > HELD:
                yield from out()
                index = LiveIndex()
    yield from out()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256; the largest id of equal texts stays.

    Copies are merged by an index within each task, then by one index for each hash range of digests.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    n = rows.count()
    kind = "digest binary, n_bytes long, keep_id long, keep_row long, group_size long"
    own = rows.select("digest", "n_bytes", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    parts = partitions_for(docs.sparkSession, n // HELD + 1)
    merged = own.mapInArrow(_merge, kind).repartition(parts, "digest").mapInArrow(_merge, kind)
    # a task of more digests than HELD passes some on twice
    newest = F.max(F.struct(F.col("keep_id").isNotNull().alias("there"), "keep_id", "keep_row")).alias("newest")
    groups = merged.groupBy("digest").agg(newest, F.sum("group_size").alias("group_size"), F.max("n_bytes").alias("n_bytes"))
    groups = groups.select("digest", "n_bytes", F.col("newest.keep_id").alias("keep_id"), F.col("newest.keep_row").alias("keep_row"), "group_size")
    several = cut(groups.where("group_size > 1").drop("n_bytes"), "groups")
    out = attach(rows.drop("n_bytes"), several, "digest", "group_size", n)
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
