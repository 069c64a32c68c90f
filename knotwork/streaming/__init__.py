"""Streams into graphs: each micro-batch of a streaming DataFrame is copied into a table, as COPY FROM would."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from knotwork.session import Session


def stream_into(session: Session, stream: DataFrame, table: str, checkpoint: str, **options) -> StreamingQuery:
    """Start copying stream's rows into a node table (its columns in order) or a relationship table (from key, to key, properties).

    A batch that is delivered again after a failure is recognised by its number, which is kept with the table it went into
    (a table of a session that died is gone, with its numbers), so rows come in once."""
    done: set[int] = session.catalog.table(table).batches.setdefault(checkpoint, set())

    def batch(df: DataFrame, number: int) -> None:
        if number not in done:
            before = {k: c.snapshot() for k, c in session.graphs.items()}
            try:
                session._copy(table, None, df, {k.upper(): v for k, v in options.items()})
            except Exception:
                session.graphs = before
                raise
            done.add(number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
