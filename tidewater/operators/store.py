"""Record mutations as table transforms, and collection facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.predicates import Filter, all_of, matching
from tidewater.plans.ranks import running_total


class RecordError(Exception):
    """A record operation that cannot be carried out."""


class NotFound(RecordError):
    pass


class DimensionMismatch(RecordError):
    pass


class EmptyVector(RecordError):
    pass


class CollectionExists(RecordError):
    pass


class ReadOnly(RecordError):
    pass


class SpaceNotFound(RecordError):
    pass


class SpaceExists(RecordError):
    pass


class ProfileMismatch(RecordError):
    pass


class NoEmbedder(RecordError):
    pass


def unique(new: DataFrame, key: str) -> DataFrame:
    """``new``; raises if a value of ``key`` comes twice."""
    if not new.groupBy(key).count().where("count > 1").isEmpty():
        raise RecordError(f"{key} repeats in the new rows")
    return new


def next_id(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1


def insert_batch(df: DataFrame, new: DataFrame, dimension: int | None = None) -> DataFrame:
    """``df`` with the rows of ``new``, ids from max + 1 in the order of ``new``'s ``seq``; all or nothing on dimension."""
    if dimension is not None and not new.where((F.size("vector") > 0) & (F.size("vector") != dimension)).isEmpty():
        raise DimensionMismatch(f"vectors must have {dimension} numbers")
    top = df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = running_total(new, [F.col("seq")], name="_n").withColumn("id", (F.col("_n") + top + 1).cast("long")).drop("_n", "seq")
    return df.unionByName(numbered, allowMissingColumns=True)


def upsert_by_id(df: DataFrame, new: DataFrame, replace: list[str]) -> DataFrame:
    """Rows of ``new`` replace columns ``replace`` of the same id, or are added; a null id or 0 gets the next free one.

    Raises if an id comes twice.
    """
    unnamed = F.coalesce(F.col("id"), F.lit(0)) == 0
    if not new.where(unnamed).isEmpty():
        top = max(next_id(df), next_id(new.where(~unnamed)))
        made = running_total(new.where(unnamed), [F.struct(*(F.col(c) for c in replace))], name="_n")
        new = new.where(~unnamed).unionByName(made.withColumn("id", (F.col("_n") + top).cast("long")).drop("_n"))
    return _replaced(df, unique(new, "id"), replace)


def _replaced(df: DataFrame, new: DataFrame, replace: list[str]) -> DataFrame:
    out = df.join(new.select("id", F.struct(*replace).alias("_new")), "id", "full")
    for c in replace:
        out = out.withColumn(c, F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)))
    return out.drop("_new")


def upsert_by_key(df: DataFrame, new: DataFrame, key: str, replace: list[str]) -> DataFrame:
    """As :func:`upsert_by_id`, by a payload key: the least id of several matches is replaced; new keys get new ids."""
    new = unique(new, key)
    target = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("_target"))
    found = new.join(target, key, "left")
    top = df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    old = found.where("_target is not null").withColumn("id", F.col("_target")).drop("_target")
    fresh = running_total(found.where("_target is null").drop("_target"), [F.col(key)], name="_n").withColumn("id", F.col("_n") + top + 1).drop("_n")
    return _replaced(df, old, replace).unionByName(fresh, allowMissingColumns=True)


def update(df: DataFrame, which: Column, values: dict[str, Column]) -> DataFrame:
    """Values of the chosen rows are replaced."""
    return df.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in values.items()})


def set_space_vector(df: DataFrame, which: Column, space: str, vector: Column) -> DataFrame:
    rest = F.map_filter(F.coalesce("vectors", F.create_map().cast("map<string,array<float>>")), lambda k, _: k != space)
    return df.withColumn("vectors", F.when(which, F.map_concat(rest, F.create_map(F.lit(space), vector))).otherwise(F.col("vectors")))


def delete_where(df: DataFrame, *filters: Filter) -> DataFrame:
    """``df`` without the rows that pass all filters; no filters delete nothing."""
    return df.where(~all_of(*filters).safe(df)) if filters else df


def find(df: DataFrame, *filters: Filter) -> DataFrame:
    return matching(df, *filters)


def find_one(df: DataFrame, *filters: Filter) -> DataFrame:
    """The match with the least id; raises NotFound without one."""
    out = matching(df, *filters).orderBy("id").limit(1)
    if out.isEmpty():
        raise NotFound("no record matches")
    return out


def get(df: DataFrame, record_id: int) -> DataFrame:
    out = df.where(F.col("id") == record_id)
    if out.isEmpty():
        raise NotFound(str(record_id))
    return out


def page(df: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows by ascending id."""
    out = df.orderBy("id")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def collection_stats(df: DataFrame) -> DataFrame:
    some = F.coalesce(F.size("vector") > 0, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("count"), F.count_if(some).alias("vector_count"), F.count_if(~some).alias("text_only"), F.max(F.when(some, F.size("vector"))).alias("dimension"))


def space_stats(df: DataFrame) -> DataFrame:
    """Records in each vector space, the default one first."""
    main = df.where(F.size("vector") > 0).agg(F.count(F.lit(1)).alias("count")).select(F.lit("default").alias("space"), "count")
    return main.unionAll(df.select(F.explode(F.map_keys("vectors")).alias("space")).groupBy("space").count())


def validate(df: DataFrame) -> DataFrame:
    """Rows and all-zero vectors for each vector length; an empty vector counts as all zero."""
    return df.groupBy(F.coalesce(F.size("vector"), F.lit(0)).alias("dimension")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.forall("vector", lambda x: x == 0), F.lit(True))).alias("zero_vectors")
    )


def schema_sample(df: DataFrame, json_col: str, rows: int = 50) -> DataFrame:
    """Fields of a JSON payload and their types over the first ``rows`` records by id."""
    first = df.orderBy("id").limit(rows)
    fields = first.select(F.explode(F.from_json(json_col, "map<string,string>")).alias("field", "value"))
    kind = F.when(F.col("value").rlike("^-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").when(F.col("value").isin("true", "false"), "bool").otherwise("string")
    return fields.groupBy("field", kind.alias("type")).agg(F.count(F.lit(1)).alias("count"))


def replay(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """``snapshot`` after a change log ``(seq, op, id, ...)``: the last entry of each id wins, deletes remove it.

    Entries that tie in ``seq`` go by the hash of their columns; a null ``op`` puts.
    """
    w = Window.partitionBy("id").orderBy(F.desc("seq"), F.desc(F.xxhash64(*log.columns)))
    last = log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "seq")
    return snapshot.join(last.select("id"), "id", "left_anti").unionByName(last.where("op is distinct from 'delete'").drop("op"), allowMissingColumns=True)
