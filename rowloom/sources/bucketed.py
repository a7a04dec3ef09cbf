"""Tables bucketed by row id, so that joins by id move no rows.

Rows are shuffled once, when a table is written. All tables of a store are cut into the same
buckets by the same hash, so equal ids lie in equal buckets and a join reads bucket by bucket.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.layout import DEFAULT, Layout
from rowloom.operators.columns import col, q

LAYOUT_SCHEMA = (
    "name string, version long, path string, id string, buckets int, columns string, rows long, id_sum string, id_xor long"
)


@dataclass(frozen=True)
class BucketedTable:
    """What is known of a written table; two tables with equal ``ids`` hold the same ids."""

    name: str
    version: int
    path: str
    id: str
    buckets: int
    columns: str
    rows: int
    id_sum: str
    id_xor: int

    @property
    def ids(self) -> tuple[int, str, int]:
        return self.rows, self.id_sum, self.id_xor


class BucketedStore:
    """Feature, label and prediction tables below one folder, bucketed and sorted by a unique id.

    A save writes a new folder and adds its record last: a run that is lost midway leaves the former
    version readable. Take about as many buckets as give files of 128 MB to 1 GB; the number is the store's.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 200):
        if buckets < 1:
            raise ValueError("buckets must be positive")
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _records(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(LAYOUT_SCHEMA).parquet(f"{self.root}/layouts")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def find(self, name: str) -> BucketedTable | None:
        """The last complete version of a table."""
        records = self._records()
        row = records and records.where(F.col("name") == name).orderBy(F.desc("version"), "path").first()
        return BucketedTable(**row.asDict()) if row else None

    def save(self, df: DataFrame, name: str, id_col: str = "id") -> BucketedTable:
        """Write ``df``; ids that are missing or repeat are an error, and no record is made of them."""
        former = self.find(name)
        path = f"{self.root}/tables/{uuid.uuid4().hex}"
        # a task holds one whole bucket, so each bucket is one file
        (
            df.repartition(self.buckets, col(id_col)).write.format("parquet").option("path", path)
            .bucketBy(self.buckets, id_col).sortBy(id_col).saveAsTable(_catalog_name(path))
        )
        # bucketed by id: counting rows per id needs no shuffle
        per_id = self.spark.table(_catalog_name(path)).groupBy(col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        coded = F.xxhash64("id")
        found = per_id.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most"),
            F.coalesce(F.max(F.col("id").isNull().cast("int")), F.lit(0)).alias("missing"),
            F.coalesce(F.sum(coded.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("id_sum"),
            F.coalesce(F.bit_xor(coded), F.lit(0)).alias("id_xor"),
        ).first()
        if found["most"] > 1 or found["missing"]:
            raise ValueError(f"table {name!r}: ids must be there and must not repeat")
        record = (
            name, former.version + 1 if former else 1, path, id_col, self.buckets,
            df._jdf.schema().toDDL(), found["rows"], found["id_sum"], found["id_xor"],
        )
        self.spark.createDataFrame([record], LAYOUT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/layouts")
        return BucketedTable(*record)

    def read(self, name: str) -> DataFrame:
        """A saved table; a session that has not written it is told of its buckets first."""
        table = self.find(name)
        if table is None:
            raise ValueError(f"no table {name!r}")
        known = _catalog_name(table.path)
        if not self.spark.catalog.tableExists(known):
            key = q(table.id)
            self.spark.sql(
                f"create table if not exists {known} ({table.columns}) using parquet "
                f"clustered by ({key}) sorted by ({key}) into {table.buckets} buckets location '{table.path}'"
            )
        return self.spark.table(known)

    def side_by_side(self, *names: str) -> DataFrame:
        """Blocks with the same ids next to each other, without a shuffle.

        That the ids are the same is read off the records (number of rows, sum and xor of 64-bit hashes of the
        ids, all of which were unique); a block that lacks an id or has another is an error.
        """
        tables = {n: self._known(n) for n in names}
        first = tables[names[0]]
        for name, table in tables.items():
            if (table.id, table.buckets) != (first.id, first.buckets):
                raise ValueError(f"table {name!r} is cut by another id or into other buckets than {names[0]!r}")
            if table.ids != first.ids:
                raise ValueError(f"tables {names[0]!r} and {name!r} do not hold the same ids")
        out = self.read(names[0])
        for name in names[1:]:
            out = self._joined(out, self.read(name), first.id, "inner")
        return out

    def attach(self, rows: DataFrame, name: str) -> DataFrame:
        """Bring a table's columns to ``rows``, which come from this store; rows without an id in it get NULLs."""
        return self._joined(rows, self.read(name), self._known(name).id, "left")

    def _known(self, name: str) -> BucketedTable:
        table = self.find(name)
        if table is None:
            raise ValueError(f"no table {name!r}")
        return table

    @staticmethod
    def _joined(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
        shared = ({c.lower() for c in left.columns} & {c.lower() for c in right.columns}) - {on.lower()}
        if shared:
            raise ValueError(f"blocks share columns: {sorted(shared)}")
        # sort-merge keeps the buckets for the next join; a hash table of a whole block would not fit
        return left.join(right.hint("merge"), on, how)


def _catalog_name(path: str) -> str:
    return f"rowloom_{hashlib.md5(path.encode()).hexdigest()}"


def save_predictions(store: BucketedStore, preds: DataFrame, model_ids: Sequence[str], layout: Layout = DEFAULT) -> None:
    """A table for each model of long predictions (model_id, id, split, pred): id and ``pred_<model>``."""
    for m in model_ids:
        own = preds.where(F.col("model_id") == m)
        store.save(own.select(layout.id, F.col("pred").alias(f"pred_{m}")), f"pred_{m}", layout.id)


def meta_features(
    store: BucketedStore, model_ids: Sequence[str], features: str, labels: str | None = None
) -> DataFrame:
    """Stacking rows: a feature table, each model's predictions, and the label where there is one; nothing is shuffled.

    Predictions must be there for exactly the ids of the feature table. Labels may be there for some of them.
    """
    out = store.side_by_side(features, *[f"pred_{m}" for m in model_ids])
    return store.attach(out, labels) if labels else out
