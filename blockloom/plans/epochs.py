"""Aggregate tables whose last epochs are recomputed, the older ones left as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.aggregates import validator_stats
from blockloom.sinks.append import path_exists
from blockloom.sinks.scopes import current_scopes, extend_scopes

EPOCHS_A_SCOPE = 256


def _scope_of(epoch, size: int):
    return F.concat(F.lit("e"), F.floor(epoch / size).cast("bigint").cast("string"))


def refresh_epochs(
    stats: DataFrame, table: str, first_epoch: int, last_epoch: int, commit_id: str | None = None, size: int = EPOCHS_A_SCOPE
) -> int:
    """Replace the rows of all epochs from ``first_epoch`` on by ``stats``, in one commit.

    ``stats`` has a column ``epoch`` between the two. Epochs share a scope by ``size``; only
    rows from ``first_epoch`` on are written, so older epochs, and scopes that hold none of
    the others, keep their files. Stored epochs past ``last_epoch`` are dropped too: they
    were computed under a head that is no longer there. Returns the commit number.
    """
    spark = stats.sparkSession
    rows = stats.filter(F.col("epoch").between(first_epoch, last_epoch))
    rows = rows.withColumn("partition_key", _scope_of(F.col("epoch"), size))
    cuts = {f"e{n}": max(first_epoch, n * size) for n in range(first_epoch // size, last_epoch // size + 1)}
    if path_exists(spark, f"{table}/commits"):
        number = F.regexp_extract("scope", "^e(-?[0-9]+)$", 1).try_cast("bigint")
        later = current_scopes(spark, table).filter((number > last_epoch // size) & (F.col("row_count") > 0))
        cuts |= {row.scope: int(row.scope[1:]) * size for row in later.select("scope").collect()}
    return extend_scopes(rows, table, cuts, "epoch", commit_id=commit_id)


def refresh_validator_stats(
    duties: DataFrame,
    table: str,
    epoch_lookback: int | None,
    current_epoch: int | None = None,
    commit_id: str | None = None,
    size: int = EPOCHS_A_SCOPE,
) -> int:
    """Recompute the statistics of the current epoch and ``epoch_lookback`` epochs before it.

    Duties that arrive late change these epochs, not older ones. Without a lookback every
    epoch up to the current one is computed, as the first run needs. Duties past the
    current epoch do not count yet. Returns the commit number, 0 without any duty.
    """
    if current_epoch is not None:
        duties = duties.filter(F.col("epoch") <= current_epoch)
    low, high = duties.agg(F.min("epoch"), F.max("epoch")).first()
    current = current_epoch if current_epoch is not None else high
    if current is None or (low is None and epoch_lookback is None):
        return 0
    first = low if epoch_lookback is None else current - epoch_lookback
    return refresh_epochs(validator_stats(duties, current - first, current), table, first, current, commit_id, size)
