"""Loading received CSV records: valid rows apart from those that fail, with the reason.

Input: one row per record (file_id, rec_no, raw), rec_no 0 being the header. Defined cases:
null and blank `raw` are no record; a file without a header has no fields, so its records fail
by `columns`; an empty column's type is `integer` (every one of no cells fits it); of several
key columns of one kind the first non-blank counts; a failed record given twice is reported once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.functions.text import balanced, is_blank, trim_unicode
from keystrata.plans.joins import sized_join
from keystrata.plans.session import durable
from keystrata.sources.repair import parse_column

#: Share of a column's cells that decides its type.
SHARE = 0.9
INTEGER = r"\A[+-]?[0-9]++\z"
NUMBER = r"\A[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?\z"
#: A header cell: quoted between outer spaces, or anything up to the next separator.
_NAME = r'(?:^|,)((?:(?U)\s*+"[^"]*+(?:""[^"]*+)*+"\s*+(?=,|$))|[^,]*+)'


def without_end(raw: Column) -> Column:
    """A carriage return at the end is no part of a record."""
    return F.regexp_replace(raw, r"\r\z", "")


def header_names(raw: Column) -> Column:
    """Names of a header record without byte-order mark, quotes and outer spaces, by position."""
    bare = F.regexp_replace(without_end(raw), "\\A\ufeff", "")
    cell = lambda x: trim_unicode(x)
    return F.transform(
        F.regexp_extract_all(bare, F.lit(_NAME), F.lit(1)),
        lambda x: F.when(cell(x).rlike(r'\A".*"\z'), trim_unicode(F.replace(F.substring(cell(x), F.lit(2), F.length(cell(x)) - 2), F.lit('""'), F.lit('"')))).otherwise(cell(x)),
    )


def headers(records: DataFrame) -> DataFrame:
    """(file_id, names, n): one row per file that has a header."""
    h = records.where((F.col("rec_no") == 0) & ~is_blank(F.col("raw")))
    return h.groupBy("file_id").agg(F.min("raw").alias("raw")).select("file_id", header_names(F.col("raw")).alias("names")).withColumn("n", F.size("names"))


def _is_key(name: Column) -> Column:
    return F.lower(name).isin("input", "smiles")


def _places(names: Column, kind: str) -> Column:
    """Positions of the fields of this name in any letter case."""
    at = F.transform(names, lambda x, i: F.when(F.lower(x) == kind, i))
    return F.array_compact(at)


#: White space beside a separator, a quote or an end: only such records have cells to trim.
_PADDED = r'(?U)(?:\A|[,"])\s|\s(?:\z|[,"])'


class CsvLoad:
    """The records of many files, parsed once by minimum-cost repair and checked against each file's own types."""

    def __init__(self, records: DataFrame, share: float = SHARE):
        self.share = share
        records = records.select("file_id", "rec_no", "raw")
        self.headers = durable(headers(records))
        rows = records.where((F.col("rec_no") != 0) & ~is_blank(F.col("raw"))).withColumn("raw", without_end(F.col("raw")))
        joined = sized_join(rows, self.headers.select("file_id", "n"), "file_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        p = joined.withColumn("p", parse_column(F.col("raw"), F.col("n")))
        trimmed = F.when(F.col("raw").rlike(_PADDED), F.transform("p.cells", trim_unicode)).otherwise(F.col("p.cells"))
        failed = F.col("p.reason").isNotNull()
        self.parsed = durable(p.select("file_id", "rec_no", F.when(failed, F.col("raw")).alias("raw"), F.when(~failed, trimmed).alias("cells"), F.col("p.reason").alias("syntax"), F.col("p.edits").alias("edits")))
        self.types = durable(self._types())

    def _types(self) -> DataFrame:
        """(file_id, types): the type of every column, from counts that are combined before the shuffle."""
        cell = self.parsed.where(F.col("syntax").isNull()).select("file_id", F.posexplode("cells").alias("pos", "cell")).where(F.col("cell") != "")
        counts = cell.groupBy("file_id", "pos").agg(F.count("*").alias("n"), F.count_if(F.col("cell").rlike(INTEGER)).alias("i"), F.count_if(F.col("cell").rlike(NUMBER)).alias("d"))
        need = F.lit(self.share) * F.col("n")
        kinds = counts.select("file_id", "pos", F.when(F.col("i") >= need, "integer").when(F.col("d") >= need, "number").otherwise("text").alias("kind"))
        by_file = kinds.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "kind"))).alias("kinds"))
        return self.headers.join(by_file, "file_id", "left").select(
            "file_id", F.transform("names", lambda _, i: F.coalesce(F.try_element_at("kinds", i), F.lit("integer"))).alias("types")
        )

    def checked(self) -> DataFrame:
        """(file_id, rec_no, raw, names, types, cells, key, reason, edits); a null reason marks a valid record.

        A record that parses at no cost and holds a cell of no use is edited by replacing that cell;
        any edit makes it fail. `raw` is kept for records that don't parse.
        """
        files = self.headers.join(self.types, "file_id", "left").select(
            "file_id",
            "names",
            "types",
            _places(F.col("names"), "input").alias("inputs"),
            _places(F.col("names"), "smiles").alias("smiles"),
            F.array_compact(F.transform(F.arrays_zip("names", "types"), lambda x, i: F.when(~_is_key(x["names"]) & (x["types"] != "text"), F.struct(i.alias("at"), x["types"].alias("type"))))).alias("typed"),
        )
        d = sized_join(self.parsed, files, "file_id", "left").withColumns({c: F.coalesce(c, F.array().cast(k)) for c, k in (("names", "array<string>"), ("inputs", "array<int>"), ("smiles", "array<int>"))})
        first = lambda at: F.get(F.filter(F.transform(at, lambda i: F.get("cells", i)), lambda x: x != ""), F.lit(0))
        d = d.withColumn("key", F.coalesce(first("inputs"), first("smiles"), F.lit("")))
        key = F.col("key")
        bad_key = (key == "") | key.rlike(r"(?U)\s") | ~balanced(key, "(", ")") | ~balanced(key, "[", "]")
        cell = lambda x: F.get("cells", x["at"])
        unfit = F.filter("typed", lambda x: (cell(x) != "") & F.when(x["type"] == "integer", ~cell(x).rlike(INTEGER)).otherwise(~cell(x).rlike(NUMBER)))
        replaced = F.concat(F.when(bad_key, F.array(F.lit("replace the key"))).otherwise(F.array().cast("array<string>")), F.transform(F.coalesce(unfit, F.array().cast("array<struct<at:int,type:string>>")), lambda x: F.concat(F.lit("replace "), F.get("names", x["at"]))))
        d = d.withColumn("edits", F.when(F.col("syntax").isNotNull(), F.col("edits")).otherwise(F.nullif(F.array_join(replaced, "; "), F.lit(""))))
        reason = F.coalesce("syntax", F.when(F.col("edits").isNotNull(), "value"))
        return d.select("file_id", "rec_no", "raw", "names", "types", "cells", "key", reason.alias("reason"), "edits")

    def failed(self) -> DataFrame:
        """(file_id, rec_no, reason, edits, raw) of the records that can't be loaded; `raw` only of those that don't parse."""
        return self.checked().where(F.col("reason").isNotNull()).select("file_id", "rec_no", "reason", "edits", "raw").distinct()

    def valid(self) -> DataFrame:
        """(file_id, rec_no, names, types, cells, key) of the records that load."""
        return self.checked().where(F.col("reason").isNull()).select("file_id", "rec_no", "names", "types", "cells", "key")


RECORD_SCHEMA = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("rec_no", T.IntegerType()), T.StructField("raw", T.StringType())])
