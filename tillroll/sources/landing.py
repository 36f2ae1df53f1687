"""Provider files to raw rows: text columns as sent, blanks to NULL, over-long text cut."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.staging import clean_raw
from tillroll.sources.schemas import ddl, raw_widths

# The separator of each provider's text file, and the JSON objects that are
# flattened to `object_field` columns.
SEPARATORS = {"apple": "\t", "amazon": ",", "google": ",", "roku": ",", "direct_billing": ","}
NESTED = {
    "geo_location": ("country_iso", "subdivision_iso"),
    "installment_details": ("number_of_installments",),
    "items": ("item_id",),
}


REJECT = "_reject"


def _normal(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower().lstrip("\ufeff")).strip("_")


def check_header(line: str, provider: str) -> None:
    """Raise unless the header names the provider's columns in file order. Case, spaces and punctuation do
    not count."""
    found = [_normal(name) for name in next(csv.reader([line], delimiter=SEPARATORS[provider]), [])]
    wanted = list(raw_widths(provider))
    if found == wanted:
        return
    missing = [c for c in wanted if c not in found]
    unknown = [c for c in found if c not in wanted]
    if missing or unknown:
        raise ValueError(f"{provider} header lacks {missing} and has {unknown}")
    first = next(i for i, (a, b) in enumerate(zip(found, wanted)) if a != b) if len(found) >= len(wanted) else len(found)
    raise ValueError(f"{provider} header has its columns in another order from column {first + 1} on")


def parse_text(lines: DataFrame, provider: str) -> DataFrame:
    """Text lines (column `value`) as the provider's columns and `_reject`: the line if it has more or fewer
    fields than columns, else NULL. Lines are parsed as a column, so any source of lines will do."""
    columns = dict.fromkeys([*raw_widths(provider), REJECT], "string")
    options = {
        "sep": SEPARATORS[provider],
        "quote": '"',
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": REJECT,
    }
    return lines.select(F.from_csv(F.col("value"), ddl(columns), options).alias("_row")).select("_row.*")


def parse_json(lines: DataFrame) -> DataFrame:
    """Direct-billing JSON lines (column `value`) as columns and `_reject`: the line if it is no such object."""
    columns, inner = _json_columns()
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT}
    parsed = F.from_json(F.col("value"), ddl({**columns, REJECT: "string"}), options)
    rows = lines.select(parsed.alias("_row")).select("_row.*")
    return rows.select(*_flattened(inner), REJECT)


def with_required(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """Parsed rows with `_reason`: 'fields' for a rejected line, 'missing x' where a required column is
    blank, else NULL."""
    reason = F.when(F.col(REJECT).isNotNull(), "fields")
    for name in required:
        reason = reason.when(F.coalesce(F.trim(F.col(name)), F.lit("")) == "", f"missing {name}")
    return rows.withColumn("_reason", reason)


def read_lines(spark: SparkSession, provider: str, path: str, file_format: str) -> DataFrame:
    """The data lines of a file. Of text, the header is checked and left out (in a folder, the files have
    one header)."""
    lines = spark.read.text(path)
    if file_format == "json":
        return lines.where(F.trim("value") != "")
    first = lines.first()
    if first is None:
        raise ValueError(f"{path} has no header")
    check_header(first.value, provider)
    return lines.where((F.col("value") != F.lit(first.value)) & (F.col("value") != ""))


def land_checked(
    spark: SparkSession,
    provider: str,
    path: str,
    file_tx_id: str,
    load_tx_id: str,
    required: Sequence[str] = (),
    file_format: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The raw table's rows of one file, and its rejected lines with the reason. A line is one or the other."""
    file_format = file_format or _format_of(path)
    lines = read_lines(spark, provider, path, file_format)
    parsed = parse_json(lines) if file_format == "json" else parse_text(lines, provider)
    rows = with_required(parsed, required)
    ids = [F.lit(load_tx_id).alias("load_tx_id"), F.lit(file_tx_id).alias("file_tx_id")]
    good = clean_raw(rows.where(F.col("_reason").isNull()), provider).select("*", *ids)
    line = F.coalesce(REJECT, F.to_json(F.struct(*raw_widths(provider))))
    bad = rows.where(F.col("_reason").isNotNull()).select(
        F.lit(provider).alias("provider"), line.alias("line"), F.col("_reason").alias("reason"), *ids
    )
    return good, bad


def read_text(
    spark: SparkSession, provider: str, path: str, multiline: bool = False
) -> DataFrame:
    """A CSV or TSV file with a header, read by position. Rows of another width raise."""
    columns = dict.fromkeys(raw_widths(provider), "string")
    return (
        spark.read.schema(ddl(columns))
        .option("header", True)
        .option("sep", SEPARATORS[provider])
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("multiLine", multiline)
        .csv(path)
    )


def _json_columns() -> tuple[dict[str, str], dict]:
    """The columns of a direct-billing object, and those that stand in nested ones."""
    flat = dict.fromkeys(raw_widths("direct_billing"), "string")
    nested = {
        name: f"struct<{', '.join(f'{field}: string' for field in fields)}>"
        for name, fields in NESTED.items()
    }
    inner = {
        f"{name}_{field}": F.col(name)[field] for name, fields in NESTED.items() for field in fields
    }
    return {**flat, **nested}, inner


def _flattened(inner: dict) -> list:
    flat = raw_widths("direct_billing")
    return [F.coalesce(F.col(c), inner[c]).alias(c) if c in inner else F.col(c) for c in flat]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Direct-billing JSON lines; nested objects become `object_field` columns."""
    columns, inner = _json_columns()
    rows = spark.read.schema(ddl(columns)).option("mode", "FAILFAST").json(path)
    return rows.select(*_flattened(inner))


def _format_of(path: str) -> str:
    return "json" if path.endswith((".json", ".jsonl", ".json.gz")) else "text"


def land_raw(
    spark: SparkSession,
    provider: str,
    path: str,
    file_tx_id: str,
    load_tx_id: str,
    file_format: str | None = None,
) -> DataFrame:
    """The raw table's rows of one file. The format follows the file name unless given."""
    file_format = file_format or _format_of(path)
    rows = read_json(spark, path) if file_format == "json" else read_text(spark, provider, path)
    return clean_raw(rows, provider).select(
        "*", F.lit(load_tx_id).alias("load_tx_id"), F.lit(file_tx_id).alias("file_tx_id")
    )
