"""Strict load of delimited receipt records, and the reason for each record that fails.

Every record keeps its offset. The strict load keeps a record only if it conforms in quoting, width
and the three typed columns; the failing records are the raw offsets without the loaded ones (an
anti-join), and only this remainder is diagnosed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import decimal_text

WIDTH = 7
#: While a record is cut, a comma inside quotes is this sign and ``c``, the sign itself, if a text holds it, the sign and ``s``; neither is in a valid judged field.
_MARK = "\u0001"
_ID, _AMOUNT, _TABLE = 1, 4, 5
ID_FORM = r"\A[A-Za-z0-9._/-]{1,128}\z"
AMOUNT_FORM = r"\A-?[0-9]{1,10}([.,][0-9]+)?\z"
TABLE_FORM = r"\A[1-9][0-9]{0,2}(\.0)?\z"
#: ₽ and the plain, no-break and narrow no-break spaces.
AMOUNT_NOISE = "₽   "


def _parts(raw: Column) -> Column:
    """Text between the double quotes: parts of odd index are inside a pair of them."""
    return F.split(raw, '"', -1)


def quoting_ok(parts: Column) -> Column:
    """Each field is free of quotes or wholly enclosed in them.

    Quotes pair up; between a closing and the next opening quote stands nothing (a doubled quote of
    one field) or text that starts and ends with a comma; before the first and after the last pair likewise.
    """
    last = F.size(parts) - 1
    return (last % 2 == 0) & F.forall(
        F.transform(
            parts,
            lambda x, i: (i % 2 == 1)
            | (x == "")
            | ((last == 0) | (((i == 0) | x.startswith(",")) & ((i == last) | x.endswith(",")))),
        ),
        lambda ok: ok,
    )


def fields_of(raw: Column) -> Column:
    """The fields of a well-quoted record, unquoted but with ``_MARK``; ``restored`` gives their texts."""
    parts = _parts(F.replace(raw, F.lit(_MARK), F.lit(_MARK + "s")))
    last = F.size(parts) - 1
    kept = F.transform(
        parts,
        lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(","), F.lit(_MARK + "c"))).when((x == "") & (i > 0) & (i < last), F.lit('"')).otherwise(x),
    )
    return F.split(F.array_join(kept, ""), ",", -1)


def restored(field: Column) -> Column:
    """A field's text as it stood in the record."""
    return F.replace(F.replace(field, F.lit(_MARK + "c"), F.lit(",")), F.lit(_MARK + "s"), F.lit(_MARK))


def amount_digits(field: Column) -> Column:
    """An amount without currency sign and spaces."""
    return F.translate(restored(field), AMOUNT_NOISE, "")


def _valid_amount(field: Column) -> Column:
    return (field == "") | amount_digits(field).rlike(AMOUNT_FORM)


def _valid_table(field: Column) -> Column:
    return (field == "") | field.rlike(TABLE_FORM)


def strict_load(df: DataFrame, offset: str, raw: str) -> DataFrame:
    """The conforming records, typed: offset, tt, external_receipt_id, opened_at, closed_at, amount, table_number, client_external_id.

    ``amount`` is rounded half up to cents, as decimal(16,2), which also holds the largest valid one rounded up; the times stay text; empty fields are null. The null record,
    having no fields, does not conform. Other columns of ``df`` are ignored, so their names cannot clash.
    """
    rows = df.select(F.col(offset).alias("offset"), F.col(raw).alias("raw"))
    rows = rows.where(F.col("raw").isNotNull() & quoting_ok(_parts(F.col("raw")))).withColumn("f", fields_of(F.col("raw")))
    f = [F.get("f", F.lit(i)) for i in range(WIDTH)]
    rows = rows.where((F.size("f") == WIDTH) & f[_ID].rlike(ID_FORM) & _valid_amount(f[_AMOUNT]) & _valid_table(f[_TABLE]))
    text = [F.nullif(restored(x), F.lit("")) for x in f]
    amount = F.nullif(F.translate(amount_digits(f[_AMOUNT]), ",", "."), F.lit(""))
    return rows.select(
        F.col("offset").alias(offset),
        text[0].alias("tt"),
        f[_ID].alias("external_receipt_id"),
        text[2].alias("opened_at"),
        text[3].alias("closed_at"),
        decimal_text(amount).alias("amount"),
        F.regexp_replace(text[_TABLE], r"\.0\z", "").try_cast("int").alias("table_number"),
        text[6].alias("client_external_id"),
    )


def failing_records(df: DataFrame, offset: str, raw: str) -> DataFrame:
    """(offset, reason), one row per offset the strict load did not take; the first reason that applies.

    Reasons in order: ``quoting``, ``column_count`` (also a null record), ``external_receipt_id``,
    ``amount``, ``table_number``. Records are told apart by their offset; an offset given twice is one record.
    """
    rows = df.select(F.col(offset).alias(offset), F.col(raw).alias("raw"))
    rest = rows.join(strict_load(rows, offset, "raw").select(offset), offset, "left_anti")
    f = fields_of(F.col("raw"))
    get = lambda i: F.get("f", F.lit(i))
    reason = (
        F.when(F.col("raw").isNull(), "column_count")
        .when(~quoting_ok(_parts(F.col("raw"))), "quoting")
        .when(F.size("f") != WIDTH, "column_count")
        .when(~get(_ID).rlike(ID_FORM), "external_receipt_id")
        .when(~_valid_amount(get(_AMOUNT)), "amount")
        .when(~_valid_table(get(_TABLE)), "table_number")
    )
    return rest.withColumn("f", f).select(offset, reason.alias("reason")).dropDuplicates([offset])
