"""Annotation of a stream of documents: every micro-batch runs the batch plan, which keeps no state between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from termloom.operators import annotate, tokens
from termloom.session import cut


def annotate_stream(docs: DataFrame, terms: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the mentions, with context, of a streaming docs(doc_id, text) to Parquet in ``out``, a folder per batch.

    The dictionary and what the pass over the texts looks for are made once. A batch that is run again after a failure
    replaces its own folder, so no mention is written twice."""
    terms = cut(terms)
    want = annotate.wanted(terms, cues=True)

    def each(batch: DataFrame, number: int) -> None:
        events = tokens.events(batch.select("doc_id", "text"), want).persist()
        annotate.with_context(annotate.mentions(batch, terms, events=events), batch, events).write.mode("overwrite").parquet(f"{out}/batch={number}")
        events.unpersist()

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
