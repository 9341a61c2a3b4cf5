"""A corpus made ready for training: five stages over the table ``documents``, each one written and read again."""

from pyspark.sql import functions as F

from hydroq.llm import decontaminate, language, line_dedup, pieces, simhash
from hydroq.llm.catalog import table
from hydroq.llm.common import stage


def known_language(spark, docs, sf_dir):
    """Rows whose text has letters and a main language; the model learns from the rows with text and lang."""
    return language.keep_known(docs, language.learn(docs))


def repeated_lines(spark, docs, sf_dir):
    """All rows, without lines of 40 characters and more that five documents share; n_chars follows the text."""
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark, docs, sf_dir):
    """One document of each group of near copies."""
    return simhash.keep_first(docs)


def benchmark_free(spark, docs, sf_dir):
    """Rows that hold no item of the table ``benchmark``."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def piece_ids(spark, docs, sf_dir):
    """All rows with a sampled segmentation (piece_ids) and whether decoding it gives the text again (lossless)."""
    return pieces.encode(docs, check="lossless", chars=300_000)  # the stages before have filled the executors' heaps


STAGES = [
    ("language ID", known_language),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("SentencePiece encoding", piece_ids),
]

ORACLE_SQL = None  # language ID and fingerprints have no SQL form; tests compare with a brute-force version


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
