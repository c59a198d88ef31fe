"""Scanning new files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from scanloom.operators.rulebook import Rulebook
from scanloom.plans import scan


def scan_stream(
    files: DataFrame,
    findings_path: str,
    checkpoint: str,
    book: Rulebook | None = None,
    listing: DataFrame | None = None,
    cap: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Scan a stream of file rows into a findings table.

    Every micro-batch goes through the same plan as a whole scan and replaces its own partition, so
    a batch that is repeated after a failure leaves the table as it was. A file must arrive whole,
    in one row; ``listing`` names files known from before.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        names = batch.select("project_id", "path")
        known = names if listing is None else listing.unionByName(names)
        found = scan.scan(batch, known, book, cap)
        found.write.mode("overwrite").parquet(f"{findings_path}/batch={batch_id}")

    return (
        files.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
