"""A topology change from desired assignment to message state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assignment import difference
from ..operators.keyed import acquire, release
from ..operators.messages import reset_shards


@dataclass(frozen=True)
class Rebalanced:
    """Changes by shard (with `acquired` for those we wanted), and the tables after them."""

    changes: DataFrame
    locks: DataFrame
    messages: DataFrame


def rebalance(desired: DataFrame, owned: DataFrame, locks: DataFrame, messages: DataFrame, replies: DataFrame, me: str) -> Rebalanced:
    """Release what is no longer ours, take what is free, and make the messages of taken shards readable again."""
    key = ["shard_group", "shard_id"]
    change = difference(desired, owned, me)
    freed = release(locks, change.filter("change = 'release'"), F.lit(me))
    after, wanted = acquire(freed, change.filter("change = 'acquire'"), F.lit(me))
    taken = wanted.filter("acquired").select(*key)
    changes = change.join(wanted.select(*key, "acquired"), key, "left")
    return Rebalanced(changes, after, reset_shards(messages, replies, taken))
