"""Nested values to streams of definition and repetition levels, and back.

A stream has one row a slot: the row's key, the positions of its repeated ancestors from the outermost in, rep, def and the
value. Rows stay apart by their key, so no order over the whole table is needed, and each leaf is one projection with one
explode for each repeated ancestor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shalegrid.operators.schema import leaves


def shred(df: DataFrame, key: str, path: str) -> DataFrame:
    """(key, p1..pk, rep, def, value) of the leaf with that dotted path."""
    found = {x.path: x for x in leaves(df.schema)}
    if path not in found:
        raise ValueError(f"no leaf {path!r}; there are {', '.join(found)}")
    steps = path.split(".")
    field = df.schema[steps[0]]
    # ended: the level at which an ancestor was null or empty; reached: the level of what stands here otherwise.
    out = df.select(F.col(key).alias("__key"), F.col(steps[0]).alias("__c"), F.lit(None).cast("int").alias("__ended"))
    kind, nullable, reached, depth, i = field.dataType, field.nullable, 0, 0, 1

    def present(out: DataFrame, reached: int, nullable: bool) -> tuple[DataFrame, int]:
        if not nullable:
            return out, reached
        return out.withColumn("__ended", F.when(F.col("__ended").isNull() & F.col("__c").isNull(), F.lit(reached)).otherwise(F.col("__ended"))), reached + 1

    while True:
        out, reached = present(out, reached, nullable)
        kept = ["__key", "__ended", *(f"p{j + 1}" for j in range(depth))]
        if isinstance(kind, T.StructType):
            f = kind[steps[i]]
            out = out.select(*kept, F.col("__c")[steps[i]].alias("__c"))
            kind, nullable, i = f.dataType, f.nullable, i + 1
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            out = out.withColumn("__ended", F.when(F.col("__ended").isNull() & (F.size("__c") == 0), F.lit(reached)).otherwise(F.col("__ended")))
            items = F.map_entries("__c") if isinstance(kind, T.MapType) else F.col("__c")
            depth += 1
            out = out.select(*kept, F.posexplode_outer(items).alias(f"p{depth}", "__c"))
            reached += 1
            if isinstance(kind, T.MapType):
                part = steps[i + 1]
                out = out.select(*kept, f"p{depth}", F.col("__c")[part].alias("__c"))
                kind, nullable = (kind.keyType, False) if part == "key" else (kind.valueType, kind.valueContainsNull)
            else:
                kind, nullable = kind.elementType, kind.containsNull
            i += 2
        else:
            break
    rep: Column = F.lit(0)
    for j in range(1, depth + 1):
        rep = F.when(F.coalesce(F.col(f"p{j}"), F.lit(0)) > 0, F.lit(j)).otherwise(rep)
    return out.select(F.col("__key").alias(key), *(f"p{j + 1}" for j in range(depth)), rep.alias("rep"), F.coalesce("__ended", F.lit(reached)).alias("def"), F.col("__c").alias("value"))


def assemble_value(slots: DataFrame, key: str, name: str, max_def: int) -> DataFrame:
    """(key, name) from a stream without repetition: null below max_def."""
    return slots.select(key, F.when(F.col("def") == max_def, F.col("value")).alias(name))


def assemble_struct(streams: dict[str, DataFrame], key: str, name: str, own_def: int) -> DataFrame:
    """(key, name: struct of the streams' values): null where the levels stay below the struct's own."""
    out = None
    for field, slots in streams.items():
        part = slots.select(key, F.col("def").alias(f"__d_{field}"), F.col("value").alias(f"__v_{field}"))
        out = part if out is None else out.join(part, key)
    first = next(iter(streams))
    made = F.struct(*(F.col(f"__v_{f}").alias(f) for f in streams))
    return out.select(key, F.when(F.col(f"__d_{first}") >= own_def, made).alias(name))


def _folded(slots: DataFrame, keys: list[str], position: str, item: Column, null_def: int) -> DataFrame:
    """Arrays of the items by position: null where the level stays at null_def, empty one above it."""
    grouped = slots.groupBy(*keys).agg(F.min("def").alias("__d"), F.collect_list(F.when(F.col("def") > null_def + 1, F.struct(F.col(position).alias("p"), item.alias("v")))).alias("__items"))
    values = F.transform(F.array_sort("__items"), lambda x: x["v"])
    return grouped.select(*keys, F.when(F.col("__d") > null_def, values).alias("__list"))


def assemble_list(slots: DataFrame, key: str, name: str, null_def: int = 0) -> DataFrame:
    """(key, name: array). null_def: the level of a null list; an empty one is one above, elements beyond that."""
    return _folded(slots, [key], "p1", F.col("value"), null_def).select(key, F.col("__list").alias(name))


def assemble_nested_list(slots: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name: array of arrays) from a stream with two positions, everything optional."""
    inner = slots.groupBy(key, "p1").agg(
        F.min("def").alias("__d"), F.collect_list(F.when(F.col("def") > 3, F.struct(F.col("p2").alias("p"), F.col("value").alias("v")))).alias("__items")
    )
    values = F.when(F.col("__d") > 2, F.transform(F.array_sort("__items"), lambda x: x["v"]))
    outer = inner.select(key, "p1", F.col("__d").alias("def"), values.alias("__inner"))
    return _folded(outer, [key], "p1", F.col("__inner"), 0).select(key, F.col("__list").alias(name))


def assemble_map(keys: DataFrame, values: DataFrame, key: str, name: str, null_def: int = 0) -> DataFrame:
    """(key, name: map) from the streams of its keys and values; entries keep their order."""
    both = keys.select(key, F.col("p1"), F.col("def"), F.col("value").alias("__k")).join(
        values.select(F.col(key).alias("__key"), F.col("p1").alias("__p"), F.col("value").alias("__v")), (F.col(key) == F.col("__key")) & F.col("p1").eqNullSafe(F.col("__p"))
    )
    entries = _folded(both, [key], "p1", F.struct(F.col("__k").alias("key"), F.col("__v").alias("value")), null_def)
    return entries.select(key, F.map_from_entries("__list").alias(name))
