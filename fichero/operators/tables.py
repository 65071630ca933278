"""Cleaning of extracted tables in long form: doc_key, table_no, row_no, col_no, col_name, value.

Tables are cleaned independently and in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.groups import begins, whole_groups

TABLE = ["doc_key", "table_no"]
SENTINELS = ["", "-", "nan", "None", "null"]


def _per(*also: str) -> WindowSpec:
    return Window.partitionBy(*TABLE, *also)


def _drop_empty(cells: DataFrame) -> DataFrame:
    cells = cells.withColumn("_n", F.count("value").over(_per("row_no"))).filter("_n > 0")
    return cells.withColumn("_n", F.count("value").over(_per("col_no"))).filter("_n > 0").drop("_n")


def _renumber(cells: DataFrame, column: str) -> DataFrame:
    return cells.withColumn(column, F.dense_rank().over(_per().orderBy(column)) - 1)


#: Cells up to which a table is cleaned by one task.
LARGE = 1_000_000
_TITLE = r"(?iuU)SECCI[ÓO]N\s*\d+"


def _normalised(value: str = "value") -> Column:
    clean = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))  # no other white space is left
    return F.when(~clean.isin(SENTINELS), clean)


def _is_title(value: Column | str) -> Column:
    """Whether a first cell is a section title or a whole number."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value.rlike(_TITLE), F.lit(False)) | F.coalesce(value.rlike(r"^[0-9]+$"), F.lit(False))


def clean_tables(cells: DataFrame, sparse: float = 0.1, header: float = 0.6, large: int = LARGE) -> DataFrame:
    """Cells of cleaned tables, renumbered from 0, with the names of promoted headers.

    In order: empty rows and columns go; white space is normalised; sentinels become null; rows whose first cell is a
    section title or a whole number go; columns with less than `sparse` of their cells go; a first row filled to
    `header` that is not all numbers becomes the header; generic first names and repeated names are mended.

    Tables meet in one shuffle and are folded whole, all of a batch together; what looks into values is done before, in
    the JVM. Tables of more than `large` cells are cleaned by windows instead, which spill.
    """
    big = cells.groupBy(*TABLE).count().filter(F.col("count") > large).select(*TABLE)
    if big.isEmpty():
        return _clean_whole(cells, sparse, header)
    own = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TABLE]
    named = big.select(*[F.col(c).alias(f"_{c}") for c in TABLE])
    return _clean_whole(cells.join(named, own, "left_anti"), sparse, header).unionByName(_clean_by_windows(cells.join(named, own, "left_semi"), sparse, header))


_CELL = [*TABLE, "row_no", "col_no", "col_name", "value"]


def _clean_whole(cells: DataFrame, sparse: float, header: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_groups(batches, TABLE):
            yield from _folded(x, sparse, header).to_batches(max_chunksize=10_000)

    value = _normalised()
    told = cells.select(*TABLE, "row_no", "col_no", "col_name", value.alias("value"), F.col("value").isNotNull().alias("given"))
    told = told.withColumns({"title": _is_title("value"), "number": F.coalesce(T.is_number("value"), F.lit(False))})
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"{c} {'int' if c in ('row_no', 'col_no') else kinds[c]}" for c in _CELL)
    return told.repartition(*TABLE).sortWithinPartitions(*TABLE, "row_no", "col_no").mapInArrow(run, schema)


def _lines(group: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each pair of group and number among the different pairs, and the group of each rank."""
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = int(number.min())
    span = int(number.max()) - least + 1
    key = group * span + (number - least)
    slots = (int(group.max()) + 1) * span
    if slots <= 8 * len(key) + 1024:  # few gaps: counted, not sorted
        met = np.zeros(slots, bool)
        met[key] = True
        return (np.cumsum(met) - 1)[key], np.flatnonzero(met) // span
    pairs, line = np.unique(key, return_inverse=True)
    return line.reshape(-1), pairs // span


def _dense(group: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The rank of a number among the different numbers of its group, from 0."""
    line, groups = _lines(group, number)
    return line - np.searchsorted(groups, np.arange(int(group.max(initial=-1)) + 1))[group]


def _folded(x: pa.Table, sparse: float, header: float) -> pa.Table:
    """Whole tables, in order of TABLE, row and column, cleaned. Values stay in Arrow; only names of columns are made here."""
    x = x.combine_chunks()
    table = np.cumsum(begins(x, TABLE)) - 1
    row, column, given, title, number = (x[c].to_numpy() for c in ("row_no", "col_no", "given", "title", "number"))
    row, column = row.astype(np.int64), column.astype(np.int64)
    filled = x["value"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    at = np.arange(len(table))  # cells that are left

    def many(of: np.ndarray, which: np.ndarray) -> np.ndarray:
        """For each cell left, how many of its line (rows or columns of its table) are `which`."""
        line = _lines(table[at], of[at])[0]
        return np.bincount(line, which[at])[line]

    for line in (row, column):
        at = at[many(line, given) > 0]
    first = np.zeros(len(table), bool)
    first[at] = _dense(table[at], column[at]) == 0
    at = at[many(row, first & title) == 0]
    rows = np.bincount(_lines(table[at], row[at])[1], minlength=int(table.max(initial=0)) + 1)  # of each table
    at = at[many(column, filled) >= sparse * rows[table[at]]]
    row[at], column[at] = _dense(table[at], row[at]), _dense(table[at], column[at])

    t, top = table[at], row[at] == 0
    per = lambda which: np.bincount(t, which, minlength=len(rows))[t]
    share = per(top & filled[at]) / np.maximum(1, per(top))
    promote = (rows[t] > 1) & (share >= header) & (per(top & filled[at] & ~number[at]) > 0)
    names = _names(x, at, t, column[at], top, promote, filled)
    keep = ~(promote & top)
    at, t, names = at[keep], t[keep], names.filter(pa.array(keep))
    row[at] = _dense(t, row[at])
    out = x.select([*TABLE, "value"]).take(pa.array(at))
    told = {"row_no": pa.array(row[at].astype(np.int32)), "col_no": pa.array(column[at].astype(np.int32)), "col_name": _told_apart(names, _lines(t, row[at])[0])}
    return pa.table({c: told.get(c, out[c] if c in out.column_names else None) for c in _CELL})


def _names(x: pa.Table, at: np.ndarray, t: np.ndarray, column: np.ndarray, top: np.ndarray, promote: np.ndarray, filled: np.ndarray) -> pa.Array:
    """The names of the cells left: of their column's cell in the first row where that is the header, else their own."""
    own = x["col_name"].combine_chunks().take(pa.array(at))
    if not promote.any():
        return own
    cells = np.flatnonzero(promote)
    line, tables_ = _lines(t[cells], column[cells])
    number = np.zeros(len(tables_), np.int64)
    number[line] = column[cells]
    head = np.full(len(tables_), -1)
    heads = np.flatnonzero(top[cells])[::-1]  # of several the first
    head[line[heads]] = at[cells[heads]]
    named = (head >= 0) & filled[head]
    said = x["value"].combine_chunks().take(pa.array(head, mask=~named))
    numbers, which = np.unique(number, return_inverse=True)
    said = pc.coalesce(said, pa.array([f"Col_{c}" for c in numbers.tolist()], own.type).take(pa.array(which)))
    generic = pc.and_(pa.array(number == 0), pc.is_in(said, value_set=pa.array(["0", "Col_0", ""], said.type)))
    said = pc.if_else(generic, pa.scalar("Concepto", said.type), said)
    place = np.zeros(len(at), np.int64)
    place[cells] = line
    return pc.if_else(pa.array(promote), said.take(pa.array(place)), own)


def _told_apart(names: pa.Array, row: np.ndarray) -> pa.Array:
    """Names that a row repeats, with their number. Rows are numbered in order of their cells."""
    code = pc.fill_null(names.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    key = row * (int(code.max(initial=0)) + 1) + code
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    if new.all():
        return names
    place = np.arange(len(key))
    turn = np.empty(len(key), np.int64)
    turn[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    again = turn > 0
    said = [f"{n}_{k}" if n is not None else str(k) for n, k in zip(names.filter(pa.array(again)).to_pylist(), turn[again].tolist())]
    return pc.replace_with_mask(names, pa.array(again), pa.array(said, names.type))


def _clean_by_windows(cells: DataFrame, sparse: float, header: float) -> DataFrame:
    cells = _drop_empty(cells)
    cells = cells.withColumn("value", _normalised())
    cells = _renumber(_renumber(cells, "row_no"), "col_no")
    first = F.first(F.when(F.col("col_no") == 0, F.col("value")), ignorenulls=True).over(_per("row_no"))
    cells = cells.withColumn("_first", first).filter(~_is_title("_first")).drop("_first")
    cells = cells.withColumn("_rows", F.dense_rank().over(_per().orderBy("row_no"))).withColumn("_rows", F.max("_rows").over(_per()))
    cells = cells.withColumn("_n", F.count("value").over(_per("col_no"))).filter(F.col("_n") >= sparse * F.col("_rows")).drop("_n")
    cells = _renumber(_renumber(cells, "row_no"), "col_no")

    top = F.col("row_no") == 0
    filled = F.sum(F.when(top, F.col("value").isNotNull().cast("int"))).over(_per()) / F.sum(F.when(top, 1)).over(_per())
    worded = F.max(F.when(top & F.col("value").isNotNull(), ~T.is_number("value"))).over(_per())
    promote = (F.col("_rows") > 1) & (filled >= header) & F.coalesce(worded, F.lit(False))
    cells = cells.withColumn("_promote", promote)
    named = F.first(F.when(top, F.struct(F.col("value").alias("v"))), ignorenulls=True).over(_per("col_no"))["v"]
    name = F.when(F.col("_promote"), F.coalesce(named, F.concat(F.lit("Col_"), F.col("col_no")))).otherwise(F.col("col_name"))
    cells = cells.withColumn("col_name", name).filter(~(F.col("_promote") & top))
    generic = (F.col("col_no") == 0) & F.col("col_name").isin("0", "Col_0", "") & F.col("_promote")
    cells = cells.withColumn("col_name", F.when(generic, "Concepto").otherwise(F.col("col_name")))
    turn = F.row_number().over(Window.partitionBy(*TABLE, "row_no", "col_name").orderBy("col_no")) - 1
    cells = cells.withColumn("_turn", turn).withColumn("col_name", F.when(F.col("_turn") > 0, F.concat_ws("_", "col_name", "_turn")).otherwise(F.col("col_name")))
    return _renumber(cells, "row_no").select(*_CELL)


def valid_keys(cells: DataFrame) -> DataFrame:
    """Tables of two rows and columns at least, less than three quarters of their cells null."""
    two = [F.min(c) < F.max(c) for c in ("row_no", "col_no")]
    return cells.groupBy(*TABLE).agg((two[0] & two[1] & (F.avg(F.col("value").isNull().cast("int")) < 0.75)).alias("valid")).filter("valid").select(*TABLE)


def valid_tables(cells: DataFrame) -> DataFrame:
    """Cells of valid tables."""
    return cells.join(valid_keys(cells), TABLE, "left_semi")


def content_hash(cells: DataFrame) -> DataFrame:
    """MD5 of each table's cells in order. A table's cells are gathered, as a table is one object."""
    cell = F.struct("row_no", "col_no", "col_name", "value")
    return cells.groupBy(*TABLE).agg(F.md5(F.to_json(F.array_sort(F.collect_list(cell))).cast("binary")).alias("content_hash"))


def distinct_tables(cells: DataFrame) -> DataFrame:
    """Of tables of a document with the same content the first one's cells."""
    hashes = content_hash(cells)
    first = hashes.groupBy("doc_key", "content_hash").agg(F.min("table_no").alias("table_no"))
    return cells.join(first.select(*TABLE), TABLE, "left_semi")


def to_text(cells: DataFrame) -> DataFrame:
    """doc_key, table_no, text: size, column names, an empty line, then one line a row without null cells."""
    cell = F.when(F.col("value").isNotNull(), F.concat(F.col("col_name"), F.lit(": "), F.col("value")))
    rows = cells.groupBy(*TABLE, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "col_name", cell.alias("cell")))).alias("cells"))
    line = F.array_join(F.filter(F.transform("cells", lambda c: c["cell"]), lambda c: c.isNotNull()), " | ")
    whole = rows.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line"), F.transform("cells", lambda c: c["col_name"]).alias("names")))).alias("rows"))
    names = F.get(F.col("rows"), F.lit(0))["names"]
    head = F.format_string("Tabla con %d filas y %d columnas", F.size("rows"), F.size(names))
    text = F.concat_ws("\n", head, F.concat(F.lit("Columnas: "), F.array_join(names, ", ")), F.lit(""), F.array_join(F.filter(F.transform("rows", lambda r: r["line"]), lambda x: x != ""), "\n"))
    return whole.select(*TABLE, text.alias("text"))


def shapes(cells: DataFrame) -> DataFrame:
    """Rows, columns and headers of each table."""
    names = F.array_sort(F.collect_set(F.struct("col_no", "col_name")))
    told = cells.groupBy(*TABLE).agg(F.countDistinct("row_no").alias("rows"), names.alias("names"))
    return told.select(*TABLE, "rows", F.size(F.array_distinct(F.transform("names", lambda c: c["col_no"]))).cast("long").alias("columns"), F.transform("names", lambda c: c["col_name"]).alias("headers"))


def unpivot(frame: DataFrame, doc_key: str, row_no: str, columns: list[str], table_no: int | Column = 0) -> DataFrame:
    """A wide frame as cells."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("col_no"), F.lit(c).alias("col_name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)]))
    return frame.select(F.col(doc_key).cast("string").alias("doc_key"), F.lit(table_no).alias("table_no"), F.col(row_no).cast("int").alias("row_no"), each.alias("c")).select("doc_key", "table_no", "row_no", "c.*")
