"""How filters act on each other: a packed bitmap index, and counts of every subset of them.

Which filters a document fails, its labels and its part become bits; a block of rows
is one row of the index, with a NumPy bitset for each filter, label and part. What is
left after a set of filters is AND-NOT of their bitsets, counted with popcount a block
at a time. Counts of blocks are added up, and every order of the filters is read off
the counts of its prefixes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import texts, written

#: Rows of a block of the index: 8 KB a bitset.
BLOCK = 1 << 16
#: Every subset of the filters is counted, and every order listed.
MOST_FILTERS = 7

_PART = pa.struct([("part", pa.string()), ("first", pa.int32()), ("bits", pa.binary())])
_INDEX = "n long, filters array<binary>, labels array<binary>, parts array<struct<part: string, first: int, bits: binary>>"


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _span(part: str, start: int, end: int) -> dict:
    """The bitset of rows start to end, from the byte that its first bit is in."""
    first = start // 8
    bits = np.zeros(end - first * 8, dtype=bool)
    bits[start - first * 8 :] = True
    return {"part": part, "first": first, "bits": _packed(bits)}


def bitmap_index(flags: DataFrame, filters: list[str], labels: list[str], part: str) -> DataFrame:
    """A row per block: its number of rows, a bitset for each filter, label and part.

    The named columns of filters and labels are booleans, null counting as false;
    ``part`` is text, null counting as the empty string. Other columns don't matter.
    Rows of a block are set in order of their parts, and a part's bitset starts at
    ``first`` bytes, so however many parts there are a block stays small. A table without
    rows has no blocks.
    """
    width, more = len(filters), len(labels)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows)
            for at in range(0, table.num_rows, BLOCK):
                some = table.slice(at, BLOCK).combine_chunks()
                bits = [some.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in range(width + more)]
                names = some.column(width + more).combine_chunks().dictionary_encode()
                code = names.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                bits = [b[order] for b in bits]
                ends = np.cumsum(np.bincount(code))
                own = [_span(v, int(end - size), int(end)) for v, end, size in zip(names.dictionary.to_pylist(), ends, np.bincount(code))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([some.num_rows], pa.int64()),
                        pa.array([[_packed(b) for b in bits[:width]]], pa.list_(pa.binary())),
                        pa.array([[_packed(b) for b in bits[width:]]], pa.list_(pa.binary())),
                        pa.array([own], pa.list_(_PART)),
                    ],
                    ["n", "filters", "labels", "parts"],
                )

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield from block(held)
                held = []
        if held:
            yield from block(held)

    no = F.lit(False)
    asked = [F.coalesce(flags[c], no).alias(f"b{i}") for i, c in enumerate(filters + labels)]
    return flags.select(*asked, F.coalesce(flags[part], F.lit("")).alias("part")).mapInArrow(pack, _INDEX)


def _popcount(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def subset_counts(index: DataFrame, filters: int, labels: int) -> DataFrame:
    """(part, subset, n, n_0, n_1 ...): rows of the part that fail no filter of the subset; those with each label.

    A subset's bit i stands for filter i. Every part has all subsets.
    """
    names = ["part", "subset", "n", *(f"n_{i}" for i in range(labels))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for block in batch.to_pylist():
                unpack = lambda b: np.frombuffer(b, np.uint8)
                fails = [unpack(b) for b in block["filters"]]
                marks = [unpack(b) for b in block["labels"]]
                for own in block["parts"]:
                    total = sums.setdefault(own["part"], np.zeros((1 << filters, 1 + labels), np.int64))
                    left = {0: unpack(own["bits"])}
                    span = slice(own["first"], own["first"] + len(own["bits"]))
                    for subset in range(1 << filters):
                        if subset:
                            last = subset.bit_length() - 1
                            left[subset] = left[subset ^ (1 << last)] & ~fails[last][span]
                        bits = left[subset]
                        total[subset, 0] += _popcount(bits)
                        for j, mark in enumerate(marks):
                            total[subset, 1 + j] += _popcount(bits & mark[span])
            for part, total in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(total)), pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(total[:, j]) for j in range(1 + labels))],
                    names,
                )

    schema = "part string, subset int, n long" + "".join(f", n_{i} long" for i in range(labels))
    by_block = index.mapInArrow(count, schema)
    return by_block.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in names[2:]))


def _steps(letters: str) -> tuple[list[tuple[str, int]], np.ndarray]:
    """Every order and step, and of each the filter, the subset before it and the subset after it."""
    names, sets = [], []
    for order in itertools.permutations(range(len(letters))):
        before = 0
        for step, f in enumerate(order, 1):
            names.append(("".join(letters[i] for i in order), step))
            sets.append((f, before, before | 1 << f))
            before |= 1 << f
    return names, np.array(sets)


def filter_audit(flags: DataFrame, filters: dict[str, str], labels: dict[str, str], part: str) -> DataFrame:
    """Per part, order of the filters and step: what the step's filter keeps, removes and loses.

    ``filters`` maps one letter each to a boolean column that is true where the filter
    fails, ``labels`` the name of a result column to a boolean column; see bitmap_index
    for nulls. Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    shapley and, for each label, its rows among the removed ones. Rows of zeros are
    included. ``shapley`` is the filter's removals summed over all orders. Repeated rows
    count each. A table without rows has no parts and so no rows.
    """
    letters = "".join(filters)
    k, every = len(letters), (1 << len(letters)) - 1
    if not 0 < k <= MOST_FILTERS or k != len(filters):
        raise ValueError(f"one to {MOST_FILTERS} filters of one letter each")
    index = bitmap_index(flags, list(filters.values()), list(labels.values()), part)
    counts = subset_counts(index, k, len(labels))
    cells = ["n", *(f"n_{i}" for i in range(len(labels)))]
    by_part = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", *cells))).alias("of"))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, shapley long"
    schema += "".join(f", {name} long" for name in labels)
    names, sets = _steps(letters)
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, before, after = sets.T
        for batch in batches:
            for row in batch.to_pylist():
                left = np.array([[x[c] for c in cells] for x in row["of"]])
                gone = left[before] - left[after]
                fails = left[0, 0] - left[1 << f, 0]
                alone = left[every ^ (1 << f), 0] - left[every, 0]
                shapley = np.array([gone[f == i, 0].sum() for i in range(k)])[f]
                values = [left[after, 0], gone[:, 0], fails - gone[:, 0], alone, shapley, *gone[:, 1:].T]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(f), pa.string()),
                        pa.array([x for x, _ in names]),
                        pa.array([x for _, x in names], pa.int32()),
                        *(pa.array(v, pa.int64()) for v in values),
                    ],
                    columns,
                )

    return by_part.mapInArrow(read, schema)


_UPPER = bytes(range(65, 91))
_ODD = b"#$%&*|"
_INNER = bytes(range(0x80, 0xC0))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = K.buffers(batch.column(1))
        short, few, capitals, odd, digests = [], [], [], [], []
        for i in range(batch.num_rows):
            text = data[off[i] : off[i + 1]].tobytes()
            words = text.split()
            short.append(len(words) < 200)
            few.append(100 * len(set(words)) < 50 * len(words))
            chars = len(text.translate(None, _INNER))
            capitals.append(100 * (len(text) - len(text.translate(None, _UPPER))) > 3 * chars)
            odd.append(len(text.translate(None, _ODD)) < len(text))
            digests.append(hashlib.blake2b(text, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.bool_()) for x in (short, few, capitals, odd)), pa.array(digests, pa.binary()), batch.column(2)],
            ["doc_id", "a", "b", "c", "d", "digest", "part"],
        )


def text_flags(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    label_id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """Of every document the failures a to e, the labels good and toxic, and its part.

    a: under 200 words (maximal runs of other than ASCII blanks; a null text is empty);
    b: under half of the words distinct; c: over 3 % of the code points in A-Z; d: any of
    ``#$%&*|``; e: the text of a smaller id, by digests of 128 bits. Documents without an
    id fail e never and make no other one fail. A document has a label if any of its
    rows in ``labels`` has it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    body = texts(docs, id_col, text_col, part_col).select("doc_id", "text", F.col(part_col).cast("string").alias("part"))
    flags = body.mapInArrow(_measure, f"doc_id {kind}, a boolean, b boolean, c boolean, d boolean, digest binary, part string")
    flags = written(flags, "flags")
    # One row a text; copies fold before the shuffle.
    first = written(flags.groupBy(F.col("digest").alias("same")).agg(F.min("doc_id").alias("least")), "first")
    marks = labels.select(labels[label_id_col].alias("of"), (labels[quality_col] == 1).alias("good"), (labels[toxic_col] == 1).alias("toxic"))
    marks = marks.filter("of is not null").groupBy("of").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # By id as well as text, so that copies of one text don't meet in one task.
    held = flags.join(first, (F.col("doc_id") == F.col("least")) & (F.col("digest") == F.col("same")), "left")
    held = held.withColumn("e", F.col("doc_id").isNotNull() & F.col("least").isNull())
    return held.join(marks, F.col("doc_id") == F.col("of"), "left").select("a", "b", "c", "d", "e", "good", "toxic", "part")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = text_flags(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = filter_audit(flags, {x: x.lower() for x in "ABCDE"}, {"good_lost": "good", "toxic_lost": "toxic"}, "part")
    order = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return out.select(*order)
