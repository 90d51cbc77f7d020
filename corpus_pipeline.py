"""A training corpus from raw documents: five stages, each written as a table before the next one reads it."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from clipmotif.llm import classifier, decontaminate, lines, queries, simhash
from clipmotif.llm.common import cut, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, as trained on the labels of the raw documents."""
    model = classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), f"NOT {classifier.held_out()}")
    return classifier.keep_good(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand, or nearly stand, earlier in the corpus."""
    return lines.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with their domain, n_tokens and number of copies."""
    return queries.mix(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: SQL can express neither the boosted model nor the edit join and the fingerprints
ORACLE_SQL = None


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """A hash of what the stages' tables follow from: the input files with their sizes and times, and all parameters."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    said = []
    for name in ("documents", "labels", "benchmark"):
        path = hadoop.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            said.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    for module in (classifier, decontaminate, lines, queries, simhash):
        values = {k: v for k, v in vars(module).items() if k.isupper() and isinstance(v, bool | int | float | str | tuple | list | dict)}
        said.append(f"{module.__name__} {sorted(values.items())!r}")
    return hashlib.sha256("\n".join([*sorted(said), *(name for name, _ in STAGES)]).encode()).hexdigest()


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Apply the stages to ``documents``; what lies between them is written to the shared folder.

    A stage's table is removed when the next one's is written.  With a ``folder`` of its own a run that was broken off
    goes on after the last stage that was written whole from the same inputs and parameters, and the last table stays;
    without one nothing stays but the result's checkpoint.  Rows with a null text or id, repeated rows, empty tables
    and further columns of any name pass as the stages say: null texts score as empty ones, whole rows stay or go.
    """
    own = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    paths = [hadoop.Path(f"{own}/{k}-{name}") for k, (name, _) in enumerate(STAGES[:-1])]
    files = paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = fingerprint(spark, sf_dir)
    # the mark is the name of an empty file that readers of the table pass over
    marks = [hadoop.Path(p, f"_{mark}") for p in paths]
    written = [k for k, p in enumerate(paths) if files.exists(hadoop.Path(p, "_SUCCESS")) and files.exists(marks[k])]
    docs = spark.read.parquet(paths[written[-1]].toString()) if written else table(spark, sf_dir, "documents")
    for k in range(written[-1] + 1 if written else 0, len(paths)):
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k].toString())
        files.create(marks[k], True).close()
        docs = spark.read.parquet(paths[k].toString())
        if k:
            files.delete(paths[k - 1], True)
    found = STAGES[-1][1](spark, docs, sf_dir)
    if not folder:
        found = cut(found)
        files.delete(hadoop.Path(own), True)
    return found
