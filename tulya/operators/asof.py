"""The last row at or before another: joins by order instead of equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, marks: DataFrame, by: str, order: str, carry: list[str], width: Column | None = None, tie: str | None = None) -> DataFrame:
    """rows with the ``carry`` columns of their key's last mark at or before them.

    rows and marks have ``by`` and ``order`` (and ``tie``, which ranks what is of one
    order; without it a mark counts as before the rows of its order). Both are put into
    one sequence, and the last mark's columns are carried down it, so nothing is paired
    that isn't near. ``width`` is a column that never falls as the order rises (a day of
    a time, say): with it a key's sequence is cut into such pieces, each gets what the
    pieces before it end with, and a key that holds a third of all rows isn't one task.
    Rows without a mark get nulls; rows with a null key or order too.
    """
    other = [c for c in rows.columns if c not in (by, order, tie)]
    mark = F.struct(*carry)
    shape = lambda df, is_mark, kept, value: df.select(
        F.col(by).alias("_by"), F.col(order).alias("_at"), (F.col(tie) if tie else F.lit(0 if is_mark else 1)).alias("_tie"),
        F.lit(is_mark).alias("_is_mark"), kept.alias("_row"), value.alias("_mark"),
    )
    kind = F.struct(*other) if other else F.struct(F.lit(0).alias("_"))
    known = marks.filter(F.col(by).isNotNull() & F.col(order).isNotNull())
    none_row, none_mark = F.lit(None).cast(rows.select(kind).schema[0].dataType), F.lit(None).cast(marks.select(mark).schema[0].dataType)
    both = shape(rows, False, kind, none_mark).unionByName(shape(known, True, none_row, mark))
    piece = F.lit(0) if width is None else width
    both = both.withColumn(order, F.col("_at")).withColumn("_piece", piece).drop(order)
    # Of one place in the order the mark comes first.
    inside = Window.partitionBy("_by", "_piece").orderBy("_at", "_tie", F.col("_is_mark").desc())
    out = both.withColumn("_last", F.last("_mark", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if width is not None:
        ends = both.filter("_is_mark").groupBy("_by", "_piece").agg(F.max_by("_mark", F.struct("_at", "_tie")).alias("_end"))
        pieces = both.select("_by", "_piece").distinct().join(ends, ["_by", "_piece"], "left")
        before = Window.partitionBy("_by").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.select("_by", "_piece", F.last("_end", ignorenulls=True).over(before).alias("_before"))
        out = out.join(pieces.filter("_before is not null"), ["_by", "_piece"], "left").withColumn("_last", F.coalesce("_last", "_before"))
    out = out.filter("not _is_mark").withColumn("_last", F.when(F.col("_by").isNotNull() & F.col("_at").isNotNull(), F.col("_last")))
    ids = [F.col("_by").alias(by), F.col("_at").alias(order)] + ([F.col("_tie").alias(tie)] if tie else [])
    return out.select(*ids, *(F.col("_row").getField(c).alias(c) for c in other), *(F.col("_last").getField(c).alias(c) for c in carry))


def closed_stages(log: DataFrame, by: str, ts: str, tie: str, opens: Column, closes: Column, detail: str) -> DataFrame:
    """by, opened, closed, detail, duration_ms: every opening row with the first closing row before the next opening.

    A closing row's detail takes the place of the opening one's unless it is null. What
    isn't closed before the job opens its next stage has nulls; closing rows without an
    open stage are left out.
    """
    marked = log.withColumns({"_open": opens, "_close": closes})
    starts = marked.filter("_open").select(by, ts, tie, F.col(tie).alias("opened"), F.col(ts).alias("_from"), F.col(detail).alias("_said"))
    ends = marked.filter("_close and not _open").select(by, ts, tie, detail)
    found = as_of(ends, starts.drop("_said"), by, ts, ["opened", "_from"], tie=tie).filter("opened is not null")
    first = found.groupBy(F.col("opened").alias("_of")).agg(F.min(F.struct(ts, tie, detail)).alias("_end"))
    out = starts.join(first, F.col("opened") == F.col("_of"), "left")
    ms = (F.unix_micros(F.col(f"_end.{ts}").cast("timestamp")) - F.unix_micros(F.col("_from").cast("timestamp"))) / 1000
    return out.select(by, "opened", F.col(f"_end.{tie}").alias("closed"), F.coalesce(F.col(f"_end.{detail}"), F.col("_said")).alias("detail"), F.floor(ms).cast("long").alias("duration_ms"))


def page_of_findings(findings: DataFrame, blocks: DataFrame, doc_col: str = "doc_id", block_col: str = "block_ord", page_col: str = "page_no") -> DataFrame:
    """Findings with the page of their block, or of the last block before it that has one; null where none has."""
    pages = blocks.filter(F.col(page_col).isNotNull()).select(doc_col, block_col, page_col)
    return as_of(findings, pages, doc_col, block_col, [page_col])
