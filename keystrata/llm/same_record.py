"""Duplicates hidden by formatting: Merkle-style digests of records, built from the leaves up.

A node's digest comes from its children's: leaves are normalised and hashed, the digests of an
unordered node's children are sorted and hashed together, those of an ordered one are hashed in
order. Records of equal root digest are one group, confirmed by comparing the whole normalised
structure with the group's first record; equal roots of unequal structure stop the job.

Everything runs as built-in expressions. Digests are computed once and kept; copies are counted
before the shuffle (partial aggregation), so a record that makes up a third of all rows sends one
row per task. Structures are compared for the records of repeated digests only; every join back
to the rows has one row per group on its other side, so AQE may split a hot group.

Defined cases: null and blank bodies are no record; a body of blank pieces only is the record
without fields; a piece without `=` or `:` is a field without value; a repeated field counts as
often as it stands; of repeated rows with one rec_id the later ones are copies of none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions.text import is_blank, letters_digits, trim_unicode
from keystrata.plans.joins import sized_join
from keystrata.plans.session import durable

_QUOTES = "\\\"'`“”‘’«»"
_NUMBER = r"\A[+-]?[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?\z"


def fields(body: Column) -> Column:
    """The fields of a body as an array of (name, value), both normalised."""

    # Each step is a transform of its own, as a lambda evaluates an expression as often as it names it.
    pieces = F.filter(F.split(body, "[;|\n]", -1), lambda p: trim_unicode(p) != "")
    parted = F.transform(pieces, lambda p: F.struct(letters_digits(F.regexp_extract(p, r"(?s)\A([^=:]*+)", 1)).alias("name"), F.regexp_extract(p, r"(?s)\A[^=:]*+[=:](.*)\z", 1).alias("value")))
    named = F.transform(parted, lambda x: F.struct(F.when(x["name"] == "smiles", "input").otherwise(x["name"]).alias("name"), x["value"].alias("value"), F.regexp_replace(x["value"], rf"(?U)[\s{_QUOTES}]++", "").alias("rest")))
    return F.transform(named, lambda x: F.struct(x["name"].alias("name"), F.when((x["name"] == "input") | x["rest"].rlike(_NUMBER), F.lower(x["rest"])).otherwise(letters_digits(x["value"])).alias("value")))


def digest(c: Column, kind: T.DataType, leaf: Callable[[Column], Column] = lambda c: c, ordered: bool = False) -> Column:
    """Root digest of a nested column: structs and maps are unordered nodes, arrays too unless `ordered`."""

    def node(children: Column, mark: str, keep: bool) -> Column:
        return F.md5(F.concat(F.lit(mark), F.array_join(children if keep else F.array_sort(children), "")))

    if isinstance(kind, T.StructType):
        parts = F.array(*[F.md5(F.concat(F.lit(f.name.lower() + "="), digest(c[f.name], f.dataType, leaf, ordered))) for f in kind.fields])
        return node(parts, "s", False)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(node(F.transform(c, lambda x: digest(x, kind.elementType, leaf, ordered)), "a", ordered), F.md5(F.lit("null")))
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.coalesce(node(F.transform(F.map_entries(c), lambda x: digest(x, entry, leaf, ordered)), "a", False), F.md5(F.lit("null")))
    return F.coalesce(F.md5(F.concat(F.lit("v"), leaf(c.cast("string")))), F.md5(F.lit("null")))


_FIELDS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))


def records(rows: DataFrame, rec_id: str = "rec_id", body: str = "body") -> DataFrame:
    """(rec_id, root, whole): root digest and normalised structure of every non-blank record."""
    r = rows.where(~is_blank(F.col(body)) & F.col(rec_id).isNotNull()).select(F.col(rec_id).alias("rec_id"), fields(F.col(body)).alias("fields"))
    whole = F.to_json(F.array_sort("fields"))
    return r.select("rec_id", digest(F.col("fields"), _FIELDS).alias("root"), whole.alias("whole"))


def groups(recs: DataFrame) -> DataFrame:
    """(root, copies, first_id): number of copies and first record of every root digest."""
    return recs.groupBy("root").agg(F.count("*").alias("copies"), F.min("rec_id").alias("first_id"))


def copies(rows: DataFrame) -> DataFrame:
    """(first_id, rec_id): every record that repeats one of lower rec_id, with the first of its kind."""
    recs = durable(records(rows).select("rec_id", F.unhex("root").alias("root")))
    several = durable(groups(recs).where(F.col("copies") > 1).select("root", "first_id"))
    members = durable(sized_join(recs, several, "root").select("rec_id").distinct())
    given = rows.select(F.col("rec_id").alias("rec_id"), F.col("body").alias("body"))
    # Kept, or the joins' null checks on the digest would be pushed down and computed for all rows again.
    structures = durable(records(sized_join(given, members, "rec_id", "left_semi")).withColumn("root", F.unhex("root")))
    again = sized_join(structures, several, "root")
    firsts = again.where(F.col("rec_id") == F.col("first_id")).groupBy("root").agg(F.min("whole").alias("first"))
    hit = again.where(F.col("rec_id") != F.col("first_id")).join(firsts, "root")
    sure = F.when(F.col("whole") == F.col("first"), F.col("first_id")).otherwise(F.raise_error(F.lit("two records of one root digest differ")).cast("long"))
    return hit.select(sure.alias("first_id"), "rec_id").distinct()


def collapsed(rows: DataFrame) -> DataFrame:
    """(first_id, copies, record): one row per distinct record."""
    recs = durable(records(rows))
    wholes = recs.select("root", F.col("rec_id").alias("first_id"), F.col("whole").alias("record"))
    return groups(recs).join(wholes, ["root", "first_id"]).select("first_id", "copies", "record").distinct()
