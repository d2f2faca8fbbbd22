"""The ledger fed by a stream: optional forms of keep-first append and of arrows, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.ledger import arrows, dedupe
from attesta.operators.states import current_state
from attesta.schemas import IDENTITY
from attesta.store import Store


def keep_first(rows: DataFrame, watermark: str = "1 day", at: str = "created_at") -> DataFrame:
    """Each identity once while its state is kept; the sink's own anti-join covers what is older."""
    return rows.withWatermark(at, watermark).dropDuplicatesWithinWatermark(list(IDENTITY))


def append_to_store(store: Store):
    """A foreachBatch function: new identities are appended and the arrows rebuilt, in one commit; replays change nothing."""

    def run(batch: DataFrame, _: int) -> None:
        ledger = store.table("ledger")
        fresh = dedupe(batch).join(ledger.select(*IDENTITY), list(IDENTITY), "left_anti")
        missing = [c for c in ledger.columns if c not in fresh.columns]
        fresh = fresh.withColumns({c: F.lit(None).cast(ledger.schema[c].dataType) for c in missing})
        after = ledger.unionByName(fresh.select(*ledger.columns))
        table = arrows(after).withColumns({"updated_at": F.col("created_at"), "evidence": F.lit(None).cast("array<string>"), "source_ref": F.lit(None).cast("string")})
        store.commit({"ledger": after, "arrows": table})

    return run


def states_to_memory(stream: DataFrame, name: str):
    """Current states of a stream as a complete-mode table for inspection."""
    return current_state(stream).writeStream.outputMode("complete").format("memory").queryName(name).start()
