"""Delinquency events carried from one reporting day to the next."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from loanbook.book import conform
from loanbook.functions.calendar import as_date
from loanbook.operators.lifecycle import derive_delinquency_events, with_penalty_amount
from loanbook.schemas import RUN_KEY


def roll_delinquency_events(
    events: DataFrame,
    schedule: DataFrame,
    known_payments: DataFrame,
    new_payments: DataFrame,
    day: dt.date | Column,
    as_of: dt.date | Column,
) -> DataFrame:
    """Events as of ``as_of`` from those as of the earlier ``day`` and the payments that came since.

    ``events`` are those that ``known_payments`` give; ``new_payments`` may be dated on any
    day.  An open event grows older or ends with a new payment, and an ended one ends later;
    one that turns out to be paid in time goes.  An instalment without an event gets one
    from a new payment after its due day.  Instalments due since ``day`` are derived in
    full, for which the payments of these alone are looked up.  The result equals the
    derivation from all payments as of ``as_of``.
    """
    since, today = as_date(day), as_date(as_of)
    key, due = "payment_schedule_id", F.col("due_date")
    arrivals = new_payments.groupBy(key).agg(F.max("payment_date").alias("arrived"))
    carried = [RUN_KEY] if RUN_KEY in events.columns else []

    paid_on = F.greatest("delinquency_end_date", "arrived")
    due_before = F.date_sub("delinquency_start_date", 1)
    until = F.coalesce(paid_on, today)
    aged = (
        events.join(arrivals, key, "left")
        .where(until > due_before)
        .select(
            "delinquency_event_id", key, "delinquency_start_date", paid_on.alias("delinquency_end_date"),
            "overdue_principal", "overdue_interest", "overdue_fee", F.date_diff(until, due_before).alias("max_dpd"),
            "penalty_rate", F.when(paid_on.isNull(), "open").otherwise("closed").alias("delinquency_status"), *carried,
        )
    )
    settled = schedule.where(due < since).join(arrivals.select(key), key, "left_semi").join(events.select(key), key, "left_anti")
    late = derive_delinquency_events(settled, new_payments, today)
    newly_due = schedule.where((due >= since) & (due < today))
    theirs = (
        known_payments.select(key, "payment_date")
        .unionByName(new_payments.select(key, "payment_date"))
        .join(newly_due.select(key), key, "left_semi")
    )
    fresh = derive_delinquency_events(newly_due, theirs, today)
    return conform(with_penalty_amount(aged), "delinquency_events").unionByName(late).unionByName(fresh)
