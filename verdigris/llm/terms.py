"""Occurrences and record counts of every distinct term, with marks for the too rare and the too common.

Each record emits its terms with their counts; copies of a record are recognised by its id. Counts are
combined by hash on the map side before every shuffle, so a term or record that holds any share of the rows
reaches the reducers as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.session import materialise


def list_terms(df: DataFrame, record: str, terms: str) -> DataFrame:
    """(record, term, occurrences) from a list column with one row per record.

    A record delivered again with the same list counts once; one id with different lists adds them up.
    Null lists and null members hold no term; the empty text is a term.
    """
    once = df.select(F.col(f"`{record}`").alias("record"), F.array_compact(F.col(f"`{terms}`")).alias("terms")).filter("record is not null and size(terms) > 0").distinct()
    each = once.select("record", F.explode("terms").alias("term"))
    return each.groupBy("record", "term").agg(F.count(F.lit(1)).alias("occurrences"))


def row_terms(df: DataFrame, row: str, record: str, term: str) -> DataFrame:
    """(record, term, occurrences) from a table whose rows each hold one term of a record.

    A row delivered again with the same record and term counts once. Rows without a row id, a record id or a
    term are left out.
    """
    once = df.select(F.col(f"`{row}`").alias("row"), F.col(f"`{record}`").alias("record"), F.col(f"`{term}`").alias("term")).filter("row is not null and record is not null and term is not null").distinct()
    return once.groupBy("record", "term").agg(F.count(F.lit(1)).alias("occurrences"))


def term_frequencies(fields: dict[str, DataFrame], rare_records: int, common_one_in: int) -> DataFrame:
    """Per field and term: occurrences, records, all records of the field with any term, and the band.

    ``band`` is rare up to ``rare_records`` records, else common in more than one of ``common_one_in`` of the
    field's records, else usual. A term can't be both: rare comes first.
    """
    parts, totals = [], []
    for name, terms in fields.items():
        label = F.lit(name).alias("field_name")
        terms = materialise(terms, "record-terms")  # read twice below
        parts.append(terms.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.count(F.lit(1)).alias("n_records")).select(label, "*"))
        totals.append(terms.select("record").distinct().agg(F.count(F.lit(1)).alias("all_records")).select(label, "*"))
    summed, all_records = parts[0], totals[0]
    for part, total in zip(parts[1:], totals[1:], strict=True):
        summed, all_records = summed.unionByName(part), all_records.unionByName(total)
    joined = summed.join(F.broadcast(all_records), "field_name")  # one row per field
    common = F.col("n_records") * common_one_in > F.col("all_records")
    band = F.when(F.col("n_records") <= rare_records, "rare").when(common, "common").otherwise("usual")
    return joined.select("field_name", F.col("term").alias("term_value"), "occurrences", "n_records", "all_records", band.alias("band"))
