"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, and long lines further behind words of a certain
hash, so that a text of one line still has parts that survive an edit elsewhere in it.
Each paragraph's digest (with its number among equal ones) is added into one cell of
each of three tables: a count, a sum of digests, a sum of checks. Subtracting two
sketches leaves the paragraphs in one text only; cells that hold a single one are peeled
off until nothing is left. If peeling stops early, both texts are sketched again with
four times the cells. The likeness of two texts is then the Jaccard coefficient of
their paragraphs.

Rows are dealt by ranges of ids, so a document and its next one lie side by side; the
pairs across a border between two ranges are made in a second, small pass.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import texts, written

U64 = np.uint64
#: Tables of a sketch, and cells of each in a stored fingerprint, a power of two.
TABLES = 3
CELLS = 8
#: Each try has so many times the cells of the one before.
GROWTH = 4
#: One word in four ends a paragraph, and none has more words than this.
_ENDS = U64(3)
LONGEST = 16
_SALTS = [U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25), U64(0xC13FA9A902A6328F)]
_CHECK = U64(0x94D049BB133111EB)
_ORDINAL = U64(0xD1342543DE82EF95)


def paragraphs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of every paragraph of the texts; all bytes of a text belong to one of its paragraphs.

    Equal paragraphs of a row have different digests, by their number.
    """
    w = K.Words(data, off, K.BLANK_WORDS, lower=False)
    # A word with the blanks behind it; a text's first word also has those before it. A text of blanks is one word.
    blank = np.flatnonzero((np.diff(w.first) == 0) & (np.diff(off) > 0))
    starts = w.starts.copy()
    first = w.first[:-1][np.diff(w.first) > 0]
    starts[first] = off[w.row[first]]
    w.starts = np.concatenate([starts, off[blank]])
    w.row = np.concatenate([w.row, blank])
    order = np.argsort(w.starts, kind="stable")
    w.starts, w.row = w.starts[order], w.row[order]
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    w.ends = np.append(w.starts[1:], off[-1])
    hashes = w.hashes()
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    ends = (newline[w.ends] > newline[w.starts]) | (hashes & _ENDS == 0)
    ends[np.append(w.row[1:] != w.row[:-1], True)] = True
    begin = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    size = np.diff(np.append(begin, len(hashes)))
    long = np.flatnonzero(size > LONGEST)
    if len(long):
        ends[np.concatenate([np.arange(b + LONGEST - 1, b + n - 1, LONGEST) for b, n in zip(begin[long], size[long])])] = True
        begin = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    # A sum of words' hashes, each changed by its place in the paragraph.
    place = np.arange(len(hashes)) - np.repeat(begin, np.diff(np.append(begin, len(hashes))))
    digest = K.mix(np.add.reduceat(K.mix(hashes + place.astype(U64) * _ORDINAL), begin))
    row = w.row[begin]
    order = np.lexsort((digest, row))
    row, digest = row[order], digest[order]
    new = np.append(True, (row[1:] != row[:-1]) | (digest[1:] != digest[:-1]))
    number = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    return row, K.mix(digest + number.astype(U64) * _ORDINAL)


class Sketches:
    """One sketch a row: counts, sums of digests and sums of checks, rows x (TABLES * cells)."""

    def __init__(self, count: np.ndarray, keys: np.ndarray, checks: np.ndarray, cells: int):
        self.count, self.keys, self.checks, self.cells = count, keys, checks, cells

    @classmethod
    def of(cls, rows: int, row: np.ndarray, digest: np.ndarray, cells: int) -> Sketches:
        size = rows * TABLES * cells
        count, keys, checks = np.zeros(size, np.int64), np.zeros(size, U64), np.zeros(size, np.uint16)
        check = check_of(digest)
        for j in range(TABLES):
            at = row * (TABLES * cells) + j * cells + places(digest, j, cells)
            np.add.at(count, at, 1)
            np.add.at(keys, at, digest)
            np.add.at(checks, at, check)
        shape = (rows, TABLES * cells)
        return cls(count.reshape(shape), keys.reshape(shape), checks.reshape(shape), cells)

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(self.count - other.count, self.keys - other.keys, self.checks - other.checks, self.cells)

    def take(self, rows: np.ndarray | slice) -> Sketches:
        return Sketches(self.count[rows], self.keys[rows], self.checks[rows], self.cells)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(done by row, row, digest, +1 or -1) of the paragraphs in one text only; rows that aren't done count for nothing."""
        cells, n = self.cells, len(self.count)
        # A paragraph lies in one cell of a table, so within one table nothing is found twice.
        table = lambda x: [np.ascontiguousarray(x[:, j * cells : (j + 1) * cells]).ravel() for j in range(TABLES)]
        count, keys, checks = table(self.count), table(self.keys), table(self.checks)
        found = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))]
        left = 4 * sum(int((c != 0).sum()) for c in count) + 16  # a check that agrees by chance may put back what was taken
        quiet, j = 0, 0
        while quiet < TABLES and left > 0:
            look = np.flatnonzero((count[j] == 1) | (count[j] == -1))
            sign = count[j][look]
            digest = np.where(sign > 0, keys[j][look], U64(0) - keys[j][look])
            check = np.where(sign > 0, checks[j][look], np.uint16(0) - checks[j][look])
            right = np.flatnonzero((check == check_of(digest)) & (look % cells == places(digest, j, cells)))
            quiet = 0 if len(right) else quiet + 1
            if len(right):
                row, digest, sign, check = look[right] // cells, digest[right], sign[right], check[right]
                found.append((row, digest, sign))
                left -= len(right)
                key, check = np.where(sign > 0, digest, U64(0) - digest), np.where(sign > 0, check, np.uint16(0) - check)
                for k in range(TABLES):
                    at = row * cells + places(digest, k, cells)
                    np.subtract.at(count[k], at, sign)
                    np.subtract.at(keys[k], at, key)
                    np.subtract.at(checks[k], at, check)
            j = (j + 1) % TABLES
        done = np.ones(n, dtype=bool)
        for x in (*count, *keys, *checks):
            done &= (x.reshape(n, cells) == 0).all(axis=1)
        row, digest, sign = (np.concatenate(x) for x in zip(*found))
        return done, row, digest, sign

    def text(self, i: int, head: bytes) -> str:
        """Base64 of a head and the cells of a row; counts are kept to 16 bits."""
        body = self.count[i].astype("<i2").tobytes() + self.keys[i].astype("<u8").tobytes() + self.checks[i].astype("<u2").tobytes()
        return base64.b64encode(head + body).decode()


def check_of(digest: np.ndarray) -> np.ndarray:
    return (K.mix(digest ^ _CHECK) >> U64(48)).astype(np.uint16)


def places(digest: np.ndarray, table: int, cells: int) -> np.ndarray:
    """The cell of each digest in a table; another number of cells gives another draw."""
    salt = U64(int(_SALTS[table]) * cells % (1 << 64))
    return (K.mix(digest + salt) & U64(cells - 1)).astype(np.int64)


class _Texts:
    """Texts with their paragraphs; sketches of any size on demand."""

    def __init__(self, values: list[bytes]):
        off = np.zeros(len(values) + 1, np.int64)
        np.cumsum([len(v) for v in values], out=off[1:])
        self.row, self.digest = paragraphs(np.frombuffer(b"".join(values), np.uint8), off)
        self.size = np.bincount(self.row, minlength=len(values))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.n = len(values)

    def sketches(self, rows: np.ndarray, cells: int) -> Sketches:
        size = self.size[rows]
        row = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[rows], size)
        return Sketches.of(len(rows), row, self.digest[at], cells)


#: Cells in the sketches made at once.
_MOST_CELLS = 1 << 20


def likeness(a: _Texts, ia: np.ndarray, b: _Texts, ib: np.ndarray, small_a: Sketches, small_b: Sketches) -> np.ndarray:
    """Jaccard coefficient of the paragraphs of each pair of texts, from what peeling finds; 1 for two without any."""
    gone, more = np.zeros(len(ia), np.int64), np.zeros(len(ia), np.int64)
    open_, cells = np.arange(len(ia)), CELLS
    apart = np.abs(a.size[ia] - b.size[ib])
    while len(open_):
        step = max(1, _MOST_CELLS // (TABLES * cells))
        failed = [open_[apart[open_] > TABLES * cells]]  # more paragraphs apart than there are cells
        open_ = open_[apart[open_] <= TABLES * cells]
        for at in range(0, len(open_), step):
            some = open_[at : at + step]
            if cells == CELLS:
                left = small_a.take(ia[some]).minus(small_b.take(ib[some]))
            else:
                left = a.sketches(ia[some], cells).minus(b.sketches(ib[some], cells))
            done, row, _, sign = left.peel()
            ok = done[row]
            row, sign = row[ok], sign[ok]
            # A digest put back after a check agreed by chance counts +1 and -1 on the same side.
            gone[some] += np.bincount(row[sign > 0], minlength=len(some))
            more[some] += np.bincount(row[sign < 0], minlength=len(some))
            failed.append(some[~done])
        open_, cells = np.concatenate(failed), cells * GROWTH
    size_a, size_b = a.size[ia], b.size[ib]
    shared = size_a - gone
    every = size_b + gone
    return np.where(every > 0, shared / np.maximum(every, 1), 1.0)


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = [c.split()[0] for c in _OUT.split(", ")]


def _head(text: bytes, paragraphs_: int) -> bytes:
    """Number of paragraphs and a digest of the text as a whole: texts with the same paragraphs in another order differ."""
    return int(paragraphs_).to_bytes(4, "little") + hashlib.blake2b(text, digest_size=8).digest()


def fingerprint(values: list[str]) -> list[str]:
    """Fingerprints of texts."""
    raw = [v.encode("utf-8", "surrogatepass") for v in values]
    t = _Texts(raw)
    s = t.sketches(np.arange(t.n), CELLS)
    return [s.text(i, _head(raw[i], t.size[i])) for i in range(t.n)]


def _compared(own: list[str], following: list[str]) -> list[list]:
    """The columns of _OUT for texts and those that follow them."""
    halves = [len(t) // 2 for t in own]
    edited = [t[: len(t) - h] + n[:h] for t, h, n in zip(own, halves, following)]
    raw, edited_raw = [t.encode() for t in own], [t.encode() for t in edited]
    # Texts that follow are mostly the next row's own: those aren't taken apart twice.
    n = len(own)
    where, extra = np.zeros(n, np.int64), []
    for i, text in enumerate(following):
        if i + 1 < n and text is own[i + 1]:
            where[i] = i + 1
        else:
            where[i] = n + len(extra)
            extra.append(text.encode())
    a, e = _Texts(raw + extra), _Texts(edited_raw)
    sa, se = a.sketches(np.arange(a.n), CELLS), e.sketches(np.arange(n), CELLS)
    at = np.arange(n)
    return [
        [len(t) for t in own],
        [hashlib.sha256(t).hexdigest() for t in edited_raw],
        [sa.text(i, _head(raw[i], a.size[i])) for i in range(n)],
        [se.text(i, _head(edited_raw[i], e.size[i])) for i in range(n)],
        likeness(a, at, e, at, sa, se),
        likeness(a, at, a, where, sa, sa),
    ]


#: Characters of texts worked on at a time; a longer text is worked on alone.
_PIECE = 1 << 20


def _in_pieces(ids: pa.Array, own: list[str], following: list[str]) -> Iterator[tuple[pa.Array, list[list]]]:
    at = 0
    while at < len(own):
        end, size = at, 0
        while end < len(own) and (end == at or size + len(own[end]) <= _PIECE):
            size += len(own[end])
            end += 1
        yield ids.slice(at, end - at), _compared(own[at:end], following[at:end])
        at = end


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of _OUT: each text, its edited text and the next document's text compared.

    The edited text has the last floor(n_chars / 2) code points replaced by as many, or
    all, of the first ones of the next document by id; after the last comes the first,
    and a document that is alone is its own next one. Null texts are empty; two texts
    without paragraphs are alike (1). Rows with one id follow each other by their texts'
    digests, rows without an id come first. Any type of id that can be ordered will do.
    A table without rows gives none. A text of any length is sketched whole, by the task
    that has it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    body = texts(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # rand spreads rows that are equal in everything; which of them comes first makes no difference.
    keys = ["doc_id", F.xxhash64("text"), F.rand(11)]
    dealt = body.repartitionByRange(*keys).select("doc_id", "text", F.xxhash64("text").alias("tie")).sortWithinPartitions("doc_id", "tie")
    names = ["doc_id", *_FIELDS, "edge", "part", "text"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[pa.Array, str] | None = None

        def edge(which: int, row: tuple[pa.Array, str]) -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in _TYPES]
            return pa.RecordBatch.from_arrays([row[0], *none, pa.array([which], pa.int32()), pa.array([part], pa.int32()), pa.array([row[1]])], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, own = batch.column(0), batch.column(1).to_pylist()
            if held is None:
                yield edge(0, (ids.slice(0, 1), own[0]))
            else:
                ids, own = pa.concat_arrays([held[0], ids]), [held[1], *own]
            held = (ids.slice(len(ids) - 1, 1), own[-1])
            for some, columns in _in_pieces(ids.slice(0, len(ids) - 1), own[:-1], own[1:]):
                n = len(some)
                filled = [pa.array(c, t) for c, t in zip(columns, _TYPES)]
                yield pa.RecordBatch.from_arrays([some, *filled, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names)
        if held is not None:
            yield edge(1, held)

    made = written(dealt.select("doc_id", "text").mapInArrow(compare, f"doc_id {kind}, {_OUT}, edge int, part int, text string"), "compared")
    # One row a range: ranges that have rows, each with the one after it; the last one with the first.
    edges = made.filter("edge is not null")
    order = edges.filter("edge = 0").select("part")
    around = Window.partitionBy(F.lit(0)).orderBy("part")
    order = order.select("part", F.lead("part").over(around).alias("after"), F.min("part").over(around).alias("least"))
    order = order.select("part", F.coalesce("after", "least").alias("after"))
    ends = edges.filter("edge = 1").select("doc_id", "text", "part").join(order, "part")
    begins = edges.filter("edge = 0").select(F.col("part").alias("after"), F.col("text").alias("next_text"))
    border = ends.join(begins, "after").select("doc_id", "text", "next_text")

    def compare_border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for some, columns in _in_pieces(batch.column(0), own, following):
                yield pa.RecordBatch.from_arrays([some, *(pa.array(c, t) for c, t in zip(columns, _TYPES))], ["doc_id", *_FIELDS])

    inner = made.filter("edge is null").select("doc_id", *_FIELDS)
    return inner.union(border.mapInArrow(compare_border, f"doc_id {kind}, {_OUT}"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
