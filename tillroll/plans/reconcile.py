"""Reconciliation from day to day.

A run takes the rows that arrived since the last one and the rows that were still open then, matches them and
writes three partitions of its own: what it found, and the payments and charges that stay open. Older rows
that are settled are not read again, so a run costs as much as its new and open rows, however long the
history. A run counts once it is noted in `recon_runs`, after all it wrote; one that died is repeated and
writes its partitions anew.

The matchers pair rows of a key in the order of their time, and a pair depends on no later row. So runs that
are fed in the order of time find the pairs of one run over everything. A row that arrives late meets what
is still open: it takes no charge back from a payment that has it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.recon import CHARGE_ONLY, MATCHED, MATCHERS, PAYMENT_ONLY
from tillroll.sources.schemas import PSP_CHARGES, PSP_PAYMENTS, RECON_DETAIL
from tillroll.sources.tables import RevenueTables


def last_run(tables: RevenueTables, provider: str, before: date | None = None) -> date | None:
    """The provider's last run, before a day if one is given."""
    runs = tables.read("recon_runs").where(F.col("provider") == provider)
    if before is not None:
        runs = runs.where(F.col("run_day") < F.lit(before))
    return runs.agg(F.max("run_day")).first()[0]


def _open(tables: RevenueTables, table: str, provider: str, run_day: date | None) -> DataFrame:
    rows = tables.read(table).where(F.col("provider") == provider)
    return rows.where(F.col("run_day") == F.lit(run_day)).drop("provider", "run_day")


def reconcile_day(
    tables: RevenueTables, provider: str, run_day: date, payments: DataFrame, charges: DataFrame
) -> None:
    """Match the rows that arrived for this run, and those open since the run before, and store the outcome.

    Repeating the last run replaces it; a run before the last one raises, as later runs build on it.
    """
    latest = last_run(tables, provider)
    if latest is not None and run_day < latest:
        raise ValueError(f"{provider} was reconciled on {latest}; {run_day} is before that")
    before = last_run(tables, provider, run_day)
    paid = _open(tables, "recon_open_payments", provider, before).unionByName(payments.select(*PSP_PAYMENTS))
    charged = _open(tables, "recon_open_charges", provider, before).unionByName(charges.select(*PSP_CHARGES))
    found = MATCHERS[provider](paid, charged)
    if "subscription_id" not in found.columns:
        found = found.withColumn("subscription_id", F.lit(None))
    spec = {"provider": provider, "run_day": run_day}
    detail = found.select(*[F.col(c).cast(kind).alias(c) for c, kind in RECON_DETAIL.items()])
    tables.replace_partition("recon_detail", detail, **spec)
    stored = _open(tables, "recon_detail", provider, run_day)
    for table, rows, ident, state in (
        ("recon_open_payments", paid, "payment_id", PAYMENT_ONLY),
        ("recon_open_charges", charged, "charge_id", CHARGE_ONLY),
    ):
        still = stored.where(F.col("state") == state).select(ident)
        tables.renew_partition(table, rows.join(still, ident, "left_semi"), **spec)
    if latest != run_day:
        run = tables.spark.createDataFrame([(provider, run_day)], "provider string, run_day date")
        tables.append("recon_runs", run.coalesce(1))


def reconciled(tables: RevenueTables, provider: str) -> DataFrame:
    """All pairs found so far and the rows open since the last run, as one match over everything has them."""
    rows = tables.read("recon_detail").where(F.col("provider") == provider)
    known = tables.read("recon_runs").where(F.col("provider") == provider)
    done = rows.join(known.select("run_day").distinct(), "run_day", "left_semi")
    last = F.lit(last_run(tables, provider))
    return done.where((F.col("state") == MATCHED) | (F.col("run_day") == last)).select(*RECON_DETAIL)
