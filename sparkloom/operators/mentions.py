"""Which names a session's texts mention, in one pass over the texts.

Names and texts are dealt by session and block of rows; within a block the names come first and
make one automaton, then every text runs through it once. No pair of a name and a text
is ever a row. A mention is a substring, whatever stands around it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship

#: Rows of a session that one automaton reads.
BLOCK = 8192


def _last_mentions(batches: Iterator) -> Iterator:
    """From rows (session, block, idx, text) sorted so that names (null idx) come first: (session, name, last idx)."""
    import ahocorasick
    import pyarrow as pa

    key, found, automaton, ready, everywhere = None, {}, None, False, False

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], ["s", "name", "ti"])

    for b in batches:
        for s, block, idx, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (s, block) != key:
                if found:
                    yield rows()
                key, found, automaton, ready, everywhere = (s, block), {}, ahocorasick.Automaton(), False, False
            if idx is None:
                if text:
                    automaton.add_word(text, text)
                else:
                    everywhere = True
                continue
            if everywhere:
                found[""] = idx
            if not len(automaton):
                continue
            if not ready:
                automaton.make_automaton()
                ready = True
            for _, name in automaton.iter(text):
                if found.get(name, -1) < idx:
                    found[name] = idx
    if found:
        yield rows()


def last_mentions(names: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (session_id, name, ti): the last row of ``texts`` (session_id, idx, text) that holds a name of
    ``names`` (session_id, name) anywhere. The empty name is in every text."""
    ship(names.sparkSession)
    kind = names.schema["session_id"].dataType
    key = lambda df: df.withColumn("s", F.to_json(F.struct("session_id")))
    said = key(texts).select("s", F.floor(F.col("idx") / block).alias("block"), "idx", "text")
    blocks = said.select("s", "block").distinct()
    sought = key(names.distinct()).join(blocks, "s").select("s", "block", F.lit(None).cast("bigint").alias("idx"), F.col("name").alias("text"))
    both = sought.unionByName(said).repartition("s", "block").sortWithinPartitions("s", "block", F.col("idx").asc_nulls_first())
    found = both.mapInArrow(_last_mentions, "s string, name string, ti bigint").groupBy("s", "name").agg(F.max("ti").alias("ti"))
    ids = key(names.select("session_id").distinct())
    return ids.join(found, "s").select(F.col("session_id").cast(kind).alias("session_id"), "name", "ti")
