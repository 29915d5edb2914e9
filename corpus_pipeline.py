"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing to target weights, best-fit packing."""

from __future__ import annotations

from formwright.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from formwright.llm.common import saved, table


def drop_toxic(spark, docs, sf_dir):
    """Without the documents predicted toxic. Null and empty texts stay, null doc_ids too; the verdict on a doc_id is that on any of its rows; an empty table gives an empty one. All columns kept."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark, docs, sf_dir):
    """Of equal texts (null as empty) the row with the smallest doc_id; ties are rows equal in both, and become one. An empty table gives an empty one. All columns kept."""
    return exact_dedup.drop_copies(docs, keep_largest=False)


def drop_near_copies(spark, docs, sf_dir):
    """Of each near-duplicate class the smallest doc_id. Texts without words and rows without doc_id stay; an empty table gives an empty one. All columns kept."""
    return near_dedup.one_of_each(docs)


def mix_sources(spark, docs, sf_dir):
    """Each row as many times as its source's rate draws for its doc_id, in hashed order. Null is a source like others; null and empty texts are drawn too; an empty table gives an empty one."""
    return mixing.poisson_mix(docs).drop("copy", "shuffle_key")


def pack_sequences(spark, docs, sf_dir):
    """One row for each piece of each row; a null or empty text is the one id 0. Repeated rows are packed each for itself; an empty table gives an empty result."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Stages 1, 3 and 5 cannot be expressed in SQL; tests/llm hold plain versions of every stage.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; what one stage returns is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
