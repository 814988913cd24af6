"""Reading and writing files: tolerant JSON Lines, keyed unions, first and last wins, resumable output."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reps import first_wins
from ..schemas import schema


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, table: str, errors: bool = False) -> DataFrame:
    """A JSON Lines table with its schema; torn lines are dropped, a missing path is an empty table, and
    *.errors.jsonl files are left out unless asked for. `_file` is the file's name."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema(table)).withColumn("_file", F.lit(None).cast("string"))
    rows = spark.read.schema(schema(table)).option("mode", "DROPMALFORMED").json(path).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows if errors else rows.where(~F.col("_file").endswith(".errors.jsonl"))


def name_parts(rows: DataFrame) -> DataFrame:
    """`cond`, `shard`, `shards` and `run` from file names <cond>.s<k>of<n>.r<job>.jsonl."""
    f = F.col("_file")
    number = lambda p: F.when(F.regexp_extract(f, p, 1) != "", F.regexp_extract(f, p, 1).cast("int"))
    return rows.withColumns({"cond": F.element_at(F.split(f, r"\."), 1), "shard": number(r"\.s(\d+)of\d+"), "shards": number(r"\.s\d+of(\d+)"), "run": F.nullif(F.regexp_extract(f, r"\.r([^.]+)\.", 1), F.lit(""))})


def read_reps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Representations of several files; of equal keys the later file's row wins."""
    out = None
    for rank, path in enumerate(paths):
        part = read_jsonl(spark, path, "reps").withColumn("_rank", F.lit(rank)).withColumn("_row", F.monotonically_increasing_id())
        out = part if out is None else out.unionByName(part)
    return first_wins(out, ["condition", "book", "boundary", "label"], [F.col("_rank").desc(), F.col("_row").desc()]).drop("_rank", "_row", "_file")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(book, label, alias) from one JSON document per book; the book is the file's name."""
    rows = spark.read.schema(schema("aliases")).option("multiLine", True).json(path).withColumn("book", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return rows.select("book", F.explode("principals").alias("label", "aliases")).select("book", "label", F.explode("aliases").alias("alias"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(book, kind, text): ambiguous strings and protected names of each book's alias document."""
    rows = spark.read.schema(schema("aliases")).option("multiLine", True).json(path).withColumn("book", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    lists = F.map_from_arrays(F.array(F.lit("ambiguous"), F.lit("protected")), F.array(F.coalesce("ambiguous", F.array()), F.coalesce("drop_if_present", F.array())))
    return rows.select("book", F.explode(lists).alias("kind", "texts")).select("book", "kind", F.explode("texts").alias("text"))


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapter_index, label, section, pos, claim...) of ledger documents."""
    rows = spark.read.schema(schema("ledgers")).option("multiLine", True).json(path)
    people = rows.select(F.col("book_id").alias("book"), "chapter_index", F.explode("principal_characters").alias("p"))
    sections = people.select("book", "chapter_index", F.col("p.character").alias("label"), F.explode("p.sections").alias("section", "claims"))
    return sections.select("book", "chapter_index", "label", "section", F.posexplode("claims").alias("pos", "c")).select("book", "chapter_index", "label", "section", "pos", "c.*")


def pickle_to_parquet(spark: SparkSession, path: str, out: str) -> None:
    """Bring a pickled dict of text by '<book>_<label>_<boundary>' into Parquet once; only for files of one's own making."""
    import pickle
    from pathlib import Path

    with Path(path).open("rb") as f:
        rows = [(*key.rsplit("_", 1), text) for key, text in pickle.load(f).items()]
    spark.createDataFrame([(k.split("_", 1)[0], k.split("_", 1)[1], int(b), t) for k, b, t in rows], "book string, label string, boundary int, text string").write.mode("overwrite").parquet(out)


def boundaries(splits: list[DataFrame]) -> DataFrame:
    """Distinct (book, boundary) over all splits."""
    out = None
    for rows in splits:
        part = rows.select(F.col("story_id").alias("book"), F.col("chapter_index").alias("boundary"))
        out = part if out is None else out.union(part)
    return out.distinct()


def story_parts(splits: list[DataFrame]) -> DataFrame:
    """Per (book, chapter) the story parts of the first split and row that have them."""
    out = None
    for rank, rows in enumerate(splits):
        part = rows.withColumn("_rank", F.lit(rank)).withColumn("_row", F.monotonically_increasing_id())
        out = part if out is None else out.unionByName(part)
    first = first_wins(out, ["story_id", "chapter_index"], ["_rank", "_row"])
    return first.select(F.col("story_id").alias("book"), "chapter_index", F.coalesce("prior_plot_summary", F.lit("")).alias("plot"), F.coalesce("story_text", F.lit("")).alias("raw"), F.coalesce("next_chapter_synopsis", F.lit("")).alias("next"))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys aren't done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows as Parquet; the committer publishes all of them or none."""
    (rows.write.mode("append").partitionBy(*partition_by) if partition_by else rows.write.mode("append")).parquet(path)


def resume(work: DataFrame, path: str, keys: list[str], run) -> int:
    """Run what isn't in path yet, append it, and return how many rows that was."""
    spark = work.sparkSession
    left = pending(work, spark.read.parquet(path), keys) if _exists(spark, path) else work
    before = spark.read.parquet(path).count() if _exists(spark, path) else 0
    append(run(left), path)
    return spark.read.parquet(path).count() - before


def export_text(rows: DataFrame, path: str, keys: list[str], text: str = "text") -> None:
    """One text file per key under key=value folders."""
    rows.select(*keys, F.col(text).alias("value")).repartition(*keys).write.mode("overwrite").partitionBy(*keys).text(path)


def report(tables: dict[str, DataFrame], path: str, title: str = "Report") -> None:
    """An HTML page with each table (small aggregates) and its rows as JSON."""
    import html
    import json
    from pathlib import Path

    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = [r.asDict(recursive=True) for r in df.collect()]
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in df.columns) + "</tr>" for r in rows)
        data = json.dumps(rows, default=str, ensure_ascii=False).replace("<", "\\u003c")
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table><script type=application/json id=\"{html.escape(name)}\">{data}</script>")
    Path(path).write_text("\n".join(parts))


def scratch(spark: SparkSession) -> str:
    """A new folder for what a job writes on its way: under the folder that spark.checkpoint.dir names, which all executors share. Only a session in one
    process may leave that unset."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="inkstrata-")
    return f"{root}/{uuid.uuid4().hex}"


#: Spark's own switch: a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """df, written under the shared folder and read back: computed once, and of a size that Spark knows when it picks a join. What was shuffled for it
    is removed once it is written."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
