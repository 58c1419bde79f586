"""Tables laid out for pages: files by range of (sort key, id), sorted, with the bounds and the number of rows of each file.

A page behind a cursor then reads the few files that its rows lie in, whatever the table's size: the bounds tell where the cursor stands and how many
files hold the next rows. Rows without a sort key are on no page and aren't laid out. Ids are unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    spark: SparkSession
    path: str
    key: str
    row_id: str

    def files(self) -> list:
        """Files in the order of their rows: file, first and last (key, id), rows. One small row for each file."""
        return sorted(self.spark.read.parquet(f"{self.path}/bounds").collect(), key=lambda r: tuple(r["last"]))


def lay_out(rows: DataFrame, path: str, key: str, row_id: str, *, rows_per_file: int = 1_000_000) -> Layout:
    """Writes rows to path, about rows_per_file to a file."""
    spark = rows.sparkSession
    known = rows.where(F.col(key).isNotNull() & F.col(row_id).isNotNull())
    n = max(1, -(-known.count() // rows_per_file))
    ordered = known.repartitionByRange(n, key, row_id).sortWithinPartitions(key, row_id)
    ordered.write.option("parquet.block.size", str(8 << 20)).parquet(f"{path}/rows")
    at = F.struct(key, row_id)
    bounds = spark.read.parquet(f"{path}/rows").groupBy(F.input_file_name().alias("file")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("rows"))
    bounds.write.parquet(f"{path}/bounds")
    return Layout(spark, path, key, row_id)


def files_of_page(layout: Layout, size: int, after: tuple | None = None, descending: bool = False) -> list[str]:
    """The files that hold the `size` rows behind the cursor. Only the file in which the cursor stands may hold less than all of its rows."""
    out, sure = [], 0
    for f in reversed(layout.files()) if descending else layout.files():
        near, far = (tuple(f["last"]), tuple(f["first"])) if descending else (tuple(f["first"]), tuple(f["last"]))
        behind = lambda x: after is None or (x < tuple(after) if descending else x > tuple(after))
        if not behind(far):
            continue
        out.append(f["file"])
        sure += f["rows"] if behind(near) else 0
        if sure >= size:
            break
    return out


def page(layout: Layout, size: int = 50, after: tuple | None = None, descending: bool = False) -> DataFrame:
    """size + 1 rows behind the cursor (the last row's key and id), in order, so that the caller sees whether more follow."""
    chosen = files_of_page(layout, size + 1, after, descending)
    all_rows = layout.spark.read.parquet(f"{layout.path}/rows")
    rows = layout.spark.read.schema(all_rows.schema).parquet(*chosen) if chosen else all_rows.limit(0)
    if after is not None:
        key, row_id = F.col(layout.key), F.col(layout.row_id)
        at, last = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((key < at) | ((key == at) & (row_id < last)) if descending else (key > at) | ((key == at) & (row_id > last)))
    order = [F.desc(c) if descending else F.asc(c) for c in (layout.key, layout.row_id)]
    return rows.orderBy(*order).limit(size + 1)
