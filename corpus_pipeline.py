"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. The first four return the columns of documents; the last adds
n_tokens and ids.
"""

from __future__ import annotations

from noticeflow.llm import bpe, decontam, line_dedup, near_dup, quality
from noticeflow.llm.common import read
from noticeflow.llm.queries import tokenizer_file
from noticeflow.runtime import release, scratch, staged


def quality_filter(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def common_lines(spark, docs, sf_dir):
    """Lines found in 10 documents or more go."""
    return line_dedup.drop_common_lines(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near-duplicates stays."""
    return near_dup.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold 10 consecutive words of a benchmark item go."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark, docs, sf_dir):
    """Adds n_tokens and ids. Staged, so that texts go to Python in small batches."""
    return staged(bpe.encode(docs, tokenizer_file("byte_bpe_50k.json")), "encoded")


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", common_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: SQL cannot express the classifier, weighted sampling or the encoder.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents. Each stage's rows are a staged table, as every stage reads its input more than once;
    what a stage staged beside them goes when it ends, and its input too."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            done = keep(staged(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
