"""Journey questions as a stream: each micro-batch is one batch of the planner."""

from __future__ import annotations

from pyspark.sql import DataFrame

from waylark.operators.network import Network
from waylark.plans.planner import Prepared, plan, prepare


def answer_stream(net: Network | Prepared, questions: DataFrame, out: str, checkpoint: str, available_now: bool = False, **options):
    """Starts a query that writes each micro-batch's legs to a folder of its own number, so a batch that is run again replaces itself."""

    net = net if isinstance(net, Prepared) else prepare(net)

    def answer(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            plan(net, batch, **options).legs.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
