"""JSON-lines collections: tolerant and strict reads, versioned writes by bucket.

A collection that is only read may be any file or folder of lines. One that is saved has
its rows in hash buckets of the id, ``data/<writer>/bucket=<k>/``, and a list of versions,
``_versions/<n>``: a small file that names, for each bucket, the writer whose folder
holds it. A version counts from the moment its file appears, and a number is taken by
one saver only; whoever comes second merges into what the first one left. So an
upsert reads and writes the buckets of its own rows and no others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import bind, strip
from pagemill.operators.sizing import cut_lineage
from pagemill.operators.upsert import last_by_key, upsert
from pagemill.schema import DOCUMENT_SCHEMA, REQUIRED_KEYS
from pagemill.sources.files import names_in, path_exists, publish, read_text, remove

_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}


def parse_lines(lines: DataFrame) -> DataFrame:
    """Judge raw lines ``(value, ...)``: adds the document fields and ``skip_reason``.

    ``malformed`` covers broken JSON, values that are no objects and fields of
    the wrong type; ``missing_key`` an absent required key (null is accepted).
    Blank lines vanish, and blanks around a line do not count.
    """
    schema = T.StructType([*DOCUMENT_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    defaults = {
        "text_to_html_ratio": F.lit(0.0),
        "links_out_internal": F.array().cast("array<string>"),
    }

    def judged(line: Column) -> Column:
        value, doc, keys = line["value"], line["doc"], line["keys"]
        has = lambda name: F.coalesce(F.array_contains(keys, name), F.lit(False))
        missing = F.size(F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), F.coalesce(keys, F.array().cast("array<string>")))) > 0
        # As the only element of an array: nothing may follow the object.
        alone = F.coalesce(F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1, F.lit(False))
        broken = ~value.startswith("{") | ~alone | doc["_corrupt"].isNotNull()
        fields = [
            (F.when(~has(name), defaults[name]).otherwise(doc[name]) if name in defaults else doc[name]).alias(name)
            for name in DOCUMENT_SCHEMA.names
        ]
        reason = F.when(broken, F.lit("malformed")).when(missing, F.lit("missing_key"))
        return F.when(value != "", F.array(F.struct(*fields, reason.alias("skip_reason"), F.lit(True).alias("line"))))

    # Bound once per line: each line is parsed a single time, whatever is read of it.
    once = bind(
        strip(F.col("value")),
        lambda v: bind(
            F.struct(v.alias("value"), F.from_json(v, schema, _PERMISSIVE).alias("doc"), F.json_object_keys(v).alias("keys")),
            judged,
        ),
    )
    judged_lines = lines.select(*lines.columns, F.inline_outer(once).alias(*DOCUMENT_SCHEMA.names, "skip_reason", "_line"))
    return judged_lines.where("_line").drop("_line")


_LINES = "value string, file string, at struct<file:string,block:bigint,id:bigint>"


def _lines(spark: SparkSession, places: list[str]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], _LINES)
    return spark.read.text(places).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    ).select("value", "file", F.struct("file", "block", "id").alias("at"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with their file and a position that orders them within the collection."""
    return _lines(spark, current_places(spark, path))


def _documents(lines: DataFrame) -> DataFrame:
    good = parse_lines(lines).where(F.col("skip_reason").isNull())
    return last_by_key(good.select(*DOCUMENT_SCHEMA.names, F.col("at").alias("version"))).select(*DOCUMENT_SCHEMA.names)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant read: a missing path is an empty collection, bad lines are skipped,
    and the later line of a repeated id wins (files in name order).
    """
    return _documents(read_lines(spark, path))


def skip_report(parsed: DataFrame) -> DataFrame:
    """Number of loaded lines and of skipped lines per reason."""
    return parsed.groupBy(F.coalesce("skip_reason", F.lit("loaded")).alias("status")).agg(
        F.count(F.lit(1)).alias("lines")
    )


def skipped_lines(parsed: DataFrame, *place: str) -> DataFrame:
    """The skipped lines with their reason and text, and where they are: the given columns, else file and position."""
    return parsed.where(F.col("skip_reason").isNotNull()).select(*(place or ("file", "at")), "skip_reason", "value")


def skipped_line_numbers(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """``(file, line, skip_reason, value)`` of the skipped lines of a collection; lines count from 1, blank ones too.

    A file is read in splits, whose lines have consecutive ids. The numbers of lines
    per split, one row each, are summed up along their file; no line is moved. With
    ``by_folder`` the files of a folder are one text, cut into pieces in the order of their names.
    """
    lines = read_lines(spark, path)
    splits = lines.groupBy("file", "at.block").agg(F.min("at.id").alias("first"), F.count(F.lit(1)).alias("n"))
    text = F.regexp_extract("file", "^(.*)/", 1) if by_folder else F.col("file")
    earlier = Window.partitionBy(text).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    skipped = skipped_lines(parse_lines(lines)).select("file", "at.block", "at.id", "skip_reason", "value")
    return skipped.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "skip_reason", "value")


def load_strict(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Strict read: blank lines are skipped, bad JSON fails, duplicates stay.

    Without a schema the columns are inferred. An empty collection is an error.
    """
    reader = spark.read.option("mode", "FAILFAST")
    places = current_places(spark, path) or [path]
    df = (reader.schema(schema) if schema is not None else reader).json(places)
    if df.isEmpty():
        raise ValueError(f"no documents in {path}")
    return df


#: Versions that stay readable besides the newest.
KEPT_VERSIONS = 2


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name) for name in names_in(spark, f"{path}/_versions") if name.isdigit())


def _version(spark: SparkSession, path: str, number: int) -> dict:
    """``buckets``: how many there are; ``folders``: bucket number as text -> name of the writer that holds it."""
    return json.loads(read_text(spark, f"{path}/_versions/{number}"))


def _places(path: str, folders: dict[str, str], buckets: list[str] | None = None) -> list[str]:
    return [f"{path}/data/{folders[k]}/bucket={k}" for k in (folders if buckets is None else buckets) if k in folders]


def current_places(spark: SparkSession, path: str) -> list[str]:
    """The folders that hold a collection's rows; the path itself if it was not saved here; none if nothing is there."""
    path = path.rstrip("/")
    versions = _versions(spark, path)
    if versions:
        return _places(path, _version(spark, path, versions[-1])["folders"])
    return [path] if path_exists(spark, path) else []


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_buckets(documents: DataFrame, path: str, buckets: int) -> tuple[str, int]:
    """Rows to bucket folders of a writer of their own; its name and the number of rows.

    The order of lines is kept within a bucket, so the later line of an id stays the
    later one. The rebalance hint lets Spark split a bucket that one id fills.
    """
    writer, counted = uuid.uuid4().hex, Observation("saved")
    rows = documents.select(*DOCUMENT_SCHEMA.names).observe(counted, F.count(F.lit(1)).alias("rows"))
    rows = rows.withColumns({"bucket": bucket_of(F.col("doc_id"), buckets), "_line": F.monotonically_increasing_id()})
    rows = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "_line").drop("_line")
    rows.write.option("ignoreNullFields", "false").partitionBy("bucket").json(f"{path}/data/{writer}")
    return writer, counted.get["rows"]


def _written(spark: SparkSession, path: str, writer: str) -> list[str]:
    return [name.removeprefix("bucket=") for name in names_in(spark, f"{path}/data/{writer}") if name.startswith("bucket=")]


def _forget(spark: SparkSession, path: str) -> None:
    """Delete versions beyond the kept ones, and the buckets that only they name."""
    versions = _versions(spark, path)
    stay = {place for n in versions[-KEPT_VERSIONS - 1:] for place in _places(path, _version(spark, path, n)["folders"])}
    for n in versions[: -KEPT_VERSIONS - 1]:
        for place in _places(path, _version(spark, path, n)["folders"]):
            if place not in stay:
                remove(spark, place)
        remove(spark, f"{path}/_versions/{n}")


def save_documents(documents: DataFrame, path: str, buckets: int | None = None) -> int:
    """Write a whole new version of the collection at ``path``; an empty one writes nothing.

    Readers see the old version until the new one is listed, so a collection may be
    read, changed and saved back in one job. The first save fixes the number of buckets:
    by default that of shuffle partitions; a bucket is what an upsert rewrites at least.
    ``KEPT_VERSIONS`` older versions stay, for readers at work. Nulls are written and the
    field order is kept. Returns the number of rows.
    """
    spark, path = documents.sparkSession, path.rstrip("/")
    versions = _versions(spark, path)
    known = _version(spark, path, versions[-1])["buckets"] if versions else None
    buckets = known or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer, rows = _write_buckets(documents, path, buckets)
    if rows == 0:
        remove(spark, f"{path}/data/{writer}")
        return 0
    text = json.dumps({"buckets": buckets, "folders": dict.fromkeys(_written(spark, path, writer), writer)})
    while not publish(spark, f"{path}/_versions/{max(_versions(spark, path), default=0) + 1}", text):
        pass  # another saver took the number; a whole version needs nothing of the other's
    _forget(spark, path)
    return rows


def upsert_documents(new: DataFrame, path: str, order: str | None = None, buckets: int | None = None) -> int:
    """Merge ``new`` into the collection at ``path``; new rows replace stored ones of their id.

    ``order`` is as in :func:`pagemill.operators.upsert.upsert`. Only buckets with new
    rows are read and written. If another saver lists a version meanwhile, the merge is
    done again on that one, so nobody's rows are lost. Returns the number of rows
    written; without new rows nothing is.
    """
    spark, path = new.sparkSession, path.rstrip("/")
    columns = [*DOCUMENT_SCHEMA.names, *([order] if order and order not in DOCUMENT_SCHEMA.names else [])]
    new = cut_lineage(new.select(*columns))
    while True:
        versions = _versions(spark, path)
        if versions:
            base = _version(spark, path, versions[-1])
        else:  # lines that were never saved here become the first version with the new rows
            base = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "folders": {}}
        touched = [str(r["k"]) for r in new.select(bucket_of(F.col("doc_id"), base["buckets"]).alias("k")).distinct().collect()]
        if not touched:
            return 0
        stored = _documents(_lines(spark, _places(path, base["folders"], touched) if versions else current_places(spark, path)))
        writer, rows = _write_buckets(upsert(stored, new, order=order), path, base["buckets"])
        folders = base["folders"] | dict.fromkeys(_written(spark, path, writer), writer)
        if publish(spark, f"{path}/_versions/{max(versions, default=0) + 1}", json.dumps({"buckets": base["buckets"], "folders": folders})):
            _forget(spark, path)
            return rows
        remove(spark, f"{path}/data/{writer}")
