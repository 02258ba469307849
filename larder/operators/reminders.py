"""Reminders: anchor dates, next occurrences, notifications within a budget, reconciliation.

``reminders``: list_id, owner_id, frequency, weekday (ISO, 1 to 7), day_of_month, time_local ``HH:mm``, anchor_date,
is_enabled. Times are wall clock, so they are timestamps without a zone and no session zone can move them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder import fixed


def first_weekday(weekday: Column, today: Column) -> Column:
    """First date on or after ``today`` that falls on an ISO weekday."""
    return F.date_add(today, F.pmod(weekday - (F.weekday(today) + 1), F.lit(7)).cast("int"))


def anchor_dates(drafts: DataFrame, previous: DataFrame, today: Column) -> DataFrame:
    """Drafts with their ``anchor_date``: only biweekly ones have it, and an unchanged weekday keeps the old anchor."""
    old = previous.where("frequency = 'biweekly'").select(
        "list_id", F.col("weekday").alias("_weekday"), F.col("anchor_date").alias("_anchor")
    )
    kept = F.when(F.col("_weekday") == F.col("weekday"), F.col("_anchor"))
    anchor = F.when(F.col("frequency") == "biweekly", F.coalesce(kept, first_weekday(F.col("weekday"), today)))
    return drafts.join(old, "list_id", "left").withColumn("anchor_date", anchor).drop("_weekday", "_anchor")


def _at(day: Column, hour: Column) -> Column:
    return F.concat_ws(" ", day.cast("string"), F.left(hour, F.lit(5))).cast("timestamp_ntz")


def expand_occurrences(reminders: DataFrame, now: Column, count: int = fixed.OCCURRENCES_PER_REMINDER) -> DataFrame:
    """The next ``count`` times strictly after ``now`` of each enabled reminder, as ``due_at``.

    Each row computes its own dates from arithmetic near ``now``, never from the anchor onwards; no shuffle.
    """
    now = now.cast("timestamp_ntz")
    today = now.cast("date")
    weekday = F.coalesce(F.col("weekday"), F.lit(1))
    time = F.col("time_local").cast("string")
    step = F.when(F.col("frequency") == "weekly", 7).otherwise(14)
    start = F.when(
        (F.col("frequency") == "biweekly") & F.col("anchor_date").isNotNull(), F.col("anchor_date").cast("date")
    ).otherwise(first_weekday(weekday, today))
    skipped = F.greatest(F.lit(0), F.floor(F.date_diff(today, start) / step).cast("int") - 1)
    monthly = F.transform(
        F.sequence(F.lit(0), F.lit(count + 1)),
        lambda i: _month_day(F.add_months(F.trunc(today, "month"), i), F.coalesce(F.col("day_of_month"), F.lit(1))),
    )
    regular = F.transform(
        F.sequence(F.lit(0), F.lit(count + 2)), lambda i: F.date_add(start, ((skipped + i) * step).cast("int"))
    )
    days = F.when(F.col("frequency") == "monthly", monthly).otherwise(regular)
    due = F.filter(F.transform(days, lambda d: _at(d, time)), lambda t: t > now)
    return reminders.where("is_enabled").withColumn("due_at", F.explode(F.slice(due, 1, count)))


def _month_day(first: Column, day: Column) -> Column:
    """The wanted day of a month, or its last day in shorter months."""
    return F.least(F.date_add(first, (day - 1).cast("int")), F.last_day(first))


def pesos(amount: Column) -> Column:
    return F.concat(F.lit("$ "), F.replace(F.format_number(amount, 0), F.lit(","), F.lit(".")))


def notification_id(list_id: Column, due_at: Column) -> Column:
    return F.concat(F.lit(fixed.NOTIFICATION_PREFIX), list_id.cast("string"), F.lit(":"), F.date_format(due_at, "yyyyMMddHHmm"))


def plan_notifications(
    reminders: DataFrame, summaries: DataFrame, now: Column, budget: int = fixed.NOTIFICATION_BUDGET
) -> DataFrame:
    """Eight occurrences per reminder, the earliest of each owner up to the budget; ties by identifier.

    ``summaries`` is the list summary (id, name, item_count, total_cop): a reminder whose list is not there, archived or
    gone, takes nothing of the budget. The rank is limited, so tasks shuffle at most ``budget`` rows per owner.
    """
    listed = summaries.select(F.col("id").alias("list_id"), F.col("name").alias("list_name"), "item_count", "total_cop")
    due = expand_occurrences(reminders.join(listed, "list_id", "left_semi"), now).select("owner_id", "list_id", "due_at")
    products = F.when(F.col("item_count") == 1, "1 producto").otherwise(
        F.concat(F.col("item_count").cast("string"), F.lit(" productos"))
    )
    body = F.concat(F.lit('"'), "list_name", F.lit('" · '), products, F.lit(" · ~"), pesos(F.col("total_cop")))
    rank = F.row_number().over(Window.partitionBy("owner_id").orderBy("due_at", "identifier"))
    return (
        due.withColumn("identifier", notification_id(F.col("list_id"), F.col("due_at")))
        .withColumn("rank", rank)
        .where(F.col("rank") <= budget)
        .join(listed, "list_id")
        .select("owner_id", "list_id", "identifier", "due_at", "rank", F.lit("Hora del mercado").alias("title"), body.alias("body"))
    )


def reconcile(planned: DataFrame, scheduled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(identifiers to cancel, notifications to schedule): ours that are no longer planned, and everything planned."""
    ours = scheduled.where(F.startswith(F.col("identifier"), F.lit(fixed.NOTIFICATION_PREFIX)))
    return ours.join(planned.select("identifier"), "identifier", "left_anti"), planned


def parse_identifiers(scheduled: DataFrame, list_id: str = "[0-9a-f-]{36}") -> DataFrame:
    """Identifiers of ours back to their list and time; others are dropped."""
    pattern = rf"^{fixed.NOTIFICATION_PREFIX}({list_id}):([0-9]{{12}})$"
    stamp = F.regexp_extract("identifier", pattern, 2)
    return scheduled.where(F.col("identifier").rlike(pattern)).select(
        "identifier",
        F.regexp_extract("identifier", pattern, 1).alias("list_id"),
        F.to_timestamp_ntz(stamp, F.lit("yyyyMMddHHmm")).alias("due_at"),
    )
