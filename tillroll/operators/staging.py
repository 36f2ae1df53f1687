"""Raw text rows to typed rows, one function per provider.

Each is one projection without a shuffle. Casts are strict: a value that does not fit raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.clock import to_utc, us_date, wall_clock, zone_token
from tillroll.functions.money import minor_to_major
from tillroll.functions.text import clip, has_text
from tillroll.sources.schemas import LINEAGE, raw_widths, typed_schema


def clean_raw(df: DataFrame, provider: str) -> DataFrame:
    """Blank fields to NULL and over-long ones cut to the column width.

    The fields are cleaned as one array: as an expression each, those of a wide provider make a method that
    is too large for the JVM to compile, and run interpreted.
    """
    widths = raw_widths(provider)
    lineage = [c for c in LINEAGE if c in df.columns]
    limits = F.array(*[F.lit(n) for n in widths.values()])
    fields = F.array(*[F.col(c).cast("string") for c in widths])
    cleaned = F.transform(fields, lambda x, i: F.when(has_text(x), clip(x, F.get(limits, i))))
    rows = df.select(cleaned.alias("_fields"), *lineage)
    return rows.select(*[F.get("_fields", F.lit(i)).alias(c) for i, c in enumerate(widths)], *lineage)


def _typed(raw: DataFrame, provider: str, special: dict[str, Column]) -> DataFrame:
    """The typed table's columns: a special expression where given, else a plain cast. A raw column
    that is missing raises."""
    wanted = typed_schema(provider)
    missing = [name for name in wanted if name not in special and name not in raw.columns]
    if missing:
        raise ValueError(f"raw {provider} rows lack {', '.join(missing)}")
    return raw.select(
        *[
            special.get(name, F.col(name)).cast(kind).alias(name)
            if name in special or kind != "string"
            else F.col(name)
            for name, kind in wanted.items()
        ]
    )


def type_apple(raw: DataFrame, region: str | Column) -> DataFrame:
    special = {
        "begin_date": us_date(F.col("begin_date")),
        "end_date": us_date(F.col("end_date")),
        "file_tx_region": _region(region),
    }
    return _typed(raw, "apple", special)


def type_amazon(raw: DataFrame, region: str | Column) -> DataFrame:
    moment = F.col("transaction_time")
    special = {
        "transaction_time_local": wall_clock(moment),
        "transaction_time_local_tz": zone_token(moment),
        "transaction_time_utc": to_utc(moment),
        "file_tx_region": _region(region),
    }
    return _typed(raw, "amazon", special)


def type_google(raw: DataFrame, region: str | Column) -> DataFrame:
    return _typed(raw, "google", {"file_tx_region": _region(region)})


def type_roku(raw: DataFrame, region: str | Column) -> DataFrame:
    return _typed(raw, "roku", {"file_tx_region": _region(region)})


def type_billing(raw: DataFrame, region: str | Column | None = None) -> DataFrame:
    """Direct billing has no region; its amounts come in minor units."""
    special = {
        c: minor_to_major(F.col(c), F.col("currency"))
        for c in ("amount", "vat", "vat_amount", "sales_tax_amount")
    }
    special["realm"] = F.lit("direct_billing")
    return _typed(raw, "direct_billing", special)


TYPERS = {
    "apple": type_apple,
    "amazon": type_amazon,
    "google": type_google,
    "roku": type_roku,
    "direct_billing": type_billing,
}


def _region(region: str | Column) -> Column:
    return F.lit(region) if isinstance(region, str) else region
