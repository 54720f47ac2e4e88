"""Copy-on-write upsert of keyed rows into a table of sorted Parquet files.

A table is a folder of files sorted by a key, ``per_file`` rows each. A key's home is the last file that begins at or below it, else the
first. Of a key's changes the one of the largest order wins. Files whose rows stay as they are aren't touched.

Join-free tagging. Base rows and changes are one union; a single group-by with partial aggregates keeps a key's base struct and,
by max_by, its winning change, so a key with a third of all changes costs each task one row. The pair says what becomes of the row and
whether that differs. Counts by home then say which homes are dirty. Window ranks number a dirty home's rows, in slices of the
key range so that a home that took in very many rows is no single task, and cut them evenly; each new file is written by one task,
sorted by key. The files that they replace go last.

What comes to the driver are one row for each file (first key, counts), and one for each slice and home in it. A table has
count / per_file files; with ``per_file`` as a share of the table (the registered query: a 700th) both are bounded whatever its size. No
row, key or change does, and nothing of them is broadcast.

Defined results: rows and changes with a null key are left out; of repeated keys in the base the last one stays, so their file counts
as changed; of repeated changes either; changes tie-break by their whole content; columns that a change doesn't set are null
in inserted rows; nulls and NaNs equal themselves; an empty base has no homes, so nothing is written and changes are ignored; a table
whose rows are all deleted has no file; names of changes' columns may equal those of the base.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..cluster import cut, partitions, shared_table

#: From the first key of a change's home and the change: "ignore", "delete" or "set".
Verdict = Callable[[Column, Column], Column]


def _in_order(rows: DataFrame, key: str) -> DataFrame:
    """(slice, place, row) of rows sorted by key over even slices, kept."""
    dealt = rows.select(F.struct("*").alias("row")).repartitionByRange(partitions(rows), f"row.{key}").sortWithinPartitions(f"row.{key}")
    at = F.monotonically_increasing_id()
    return cut(dealt.select(F.shiftright(at, 33).cast("int").alias("slice"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), "row"))


def _known(values: list, kind: str) -> Column:
    """A constant array, read by place."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def start(rows: DataFrame, folder: str, key: str, per_file: int) -> None:
    """Writes ``rows`` as sorted files of ``per_file`` rows, the last with the rest, into a folder that isn't there."""
    own = _in_order(rows.where(F.col(key).isNotNull()), key)
    sizes = sorted((r["slice"], r["n"]) for r in own.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect())
    if not sizes:
        return
    before, total = [0] * (sizes[-1][0] + 1), 0
    for slice_, n in sizes:
        before[slice_] = total
        total += n
    file = F.floor((F.get(_known(before, "bigint"), "slice") + F.col("place")) / F.lit(per_file)).cast("int")
    _write(own.select(file.alias("file"), "row"), -(-total // per_file), folder, key)


def _write(rows: DataFrame, files: int, folder: str, key: str) -> None:
    """(file, row) as one file for each number, written by one task, sorted by key."""
    dealt = rows.repartitionById(files, "file").sortWithinPartitions(f"row.{key}")
    dealt.select("row.*").write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)


@dataclass(frozen=True)
class Home:
    path: str
    first: object
    dirty: bool
    #: Rows after the changes.
    n: int


def homes(base: DataFrame, key: str) -> list[Row]:
    """Each file's path, first key and number of rows, in order of the keys."""
    rows = base.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("rows")).collect()
    return sorted(rows, key=lambda r: (r["first"], r["path"]))


def home_of(key: Column, firsts: list, kind: str) -> Column:
    """The number of the last first key at or below ``key``, 0 if there is none: a binary search by falling steps."""
    known, steps = _known(firsts, kind), [1 << i for i in range(len(firsts).bit_length(), -1, -1)]
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(-1), lambda at, step: F.when(F.get(known, at + step) <= key, at + step).otherwise(at))
    return F.greatest(at, F.lit(0))


def tagged(base: DataFrame, changes: DataFrame, key: str, order: Iterable[str], sets: Iterable[str], firsts: list, verdict: Verdict) -> DataFrame:
    """``(key, home, had, new, differs)`` of every key: whether it had a row, its row after the change if it has one, and whether that is another."""
    kind, schema, sets = base.schema[key].dataType.simpleString(), base.schema, set(sets)
    change = F.struct(*changes.columns)
    old = base.select(F.col(key).alias("key"), F.struct(*base.columns).alias("old"), F.struct("_metadata.file_name", "_metadata.row_index").alias("at"))
    new = changes.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("key"), F.struct(*order, change.alias("c")).alias("by"), change.alias("change"))
    both = old.unionByName(new, allowMissingColumns=True)
    one = both.groupBy("key").agg(F.max_by("old", "at").alias("old"), F.max_by("change", "by").alias("change"))
    own = one.withColumn("home", home_of(F.col("key"), firsts, kind))
    said = F.when(F.col("change").isNull(), "ignore").otherwise(verdict(F.get(_known(firsts, kind), "home"), F.col("change")))

    def value(name: str) -> Column:
        if name == key:
            return F.col("key")
        return F.col("change").getField(name).cast(schema[name].dataType) if name in sets else F.col("old").getField(name)

    changed = F.struct(*(value(c).alias(c) for c in schema.names))
    after = F.when(F.col("said") == "ignore", F.col("old")).when(F.col("said") == "set", changed)
    out = own.withColumn("said", said).select("key", "home", "old", after.alias("new"))
    return out.select("key", "home", F.col("old").isNotNull().alias("had"), "new", (~F.col("old").eqNullSafe(F.col("new"))).alias("differs"))


def layout(homes: list[Home], per_file: int) -> tuple[list[int], int]:
    """The number of the new file that each home's rows begin in (-1: none), and how many new files there are.

    A home's rows are cut into the fewest even pieces. A new file joins the new file before it while both fit; only a home's first
    piece can, as two pieces of one home are always too many.
    """
    begins, files, size = [], 0, None
    for home in homes:
        if not home.dirty or not home.n:
            begins.append(-1)
            size = size if home.dirty else None
            continue
        pieces = -(-home.n // per_file)
        first = -(-home.n // pieces)
        joins = size is not None and size + first <= per_file
        begins.append(files - 1 if joins else files)
        files = begins[-1] + pieces
        size = home.n // pieces if pieces > 1 else first + (size if joins else 0)
    return begins, files


def _pieces(rows: DataFrame, homes: list[Home], begins: list[int], key: str, per_file: int) -> DataFrame:
    """(file, row) of the rows of dirty homes (home, new): window ranks in each slice, after those of the slices before."""
    own = _in_order(rows.select("home", F.col("new").alias("new"), F.col("new").getField(key).alias("key")), "key").select("slice", "row.*")
    counts = sorted((r["home"], r["slice"], r["n"]) for r in own.groupBy("slice", "home").agg(F.count(F.lit(1)).alias("n")).collect())
    slices = max((s for _, s, _ in counts), default=-1) + 1
    carried, before = [[-1, 0] for _ in range(slices)], {}
    for home, slice_, n in counts:
        if home in before:  # a home that goes on from the slice before: the first one in this slice
            carried[slice_] = [home, before[home]]
        before[home] = before.get(home, 0) + n
    goes_on, so_far = (F.get(_known([c[i] for c in carried], "bigint"), "slice") for i in (0, 1))
    rank = F.row_number().over(Window.partitionBy("slice", "home").orderBy("key")) - 1 + F.when(goes_on == F.col("home"), so_far).otherwise(0)
    by_home = lambda values: F.get(_known(values, "bigint"), "home")
    pieces = [max(1, -(-h.n // per_file)) for h in homes]
    ranked = own.select("new", rank.alias("rank"), by_home(begins).alias("begin"), by_home([h.n // p for h, p in zip(homes, pieces)]).alias("size"), by_home([h.n % p for h, p in zip(homes, pieces)]).alias("more"))
    larger = F.col("more") * (F.col("size") + 1)
    piece = F.when(F.col("rank") < larger, F.floor(F.col("rank") / (F.col("size") + 1))).otherwise(F.col("more") + F.floor((F.col("rank") - larger) / F.col("size")))
    return ranked.select((F.col("begin") + piece).cast("int").alias("file"), F.col("new").alias("row"))


def upsert(spark: SparkSession, folder: str, changes: DataFrame, key: str, order: Iterable[str], sets: Iterable[str], per_file: int, verdict: Verdict) -> list[str]:
    """Brings ``changes`` into the table of ``folder``, and gives the paths of the files that stayed as they were.

    New files are written before old ones go, so a reader should look again once this is done.
    """
    base = spark.read.parquet(folder)
    known = homes(base, key)
    pairs = shared_table(tagged(base, changes, key, order, sets, [r["first"] for r in known], verdict), "tagged")
    counts = {r["home"]: r for r in pairs.groupBy("home").agg(F.max("differs").alias("dirty"), F.count_if("had").alias("had"), F.count("new").alias("n")).collect()}
    own = []
    for i, file in enumerate(known):
        r = counts.get(i, {"dirty": False, "had": 0, "n": 0})
        own.append(Home(file["path"], file["first"], r["dirty"] or r["had"] != file["rows"], r["n"]))  # fewer keys than rows: repeated ones
    begins, files = layout(own, per_file)
    if files:
        dirty = pairs.where(F.col("new").isNotNull() & F.get(_known([h.dirty for h in own], "boolean"), "home"))
        _write(_pieces(dirty, own, begins, key, per_file), files, folder, key)
    _delete(spark, [h.path for h in own if h.dirty])
    return [h.path for h in own if not h.dirty]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop, store = spark._jvm.org.apache.hadoop.fs, None
    for path in paths:
        at = hadoop.Path(spark._jvm.java.net.URI(path))
        store = store or at.getFileSystem(spark._jsc.hadoopConfiguration())
        store.delete(at, False)


def table(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The table's rows, none if it has no file."""
    return spark.read.schema(schema).parquet(folder)
