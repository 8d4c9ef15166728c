"""A mailbox state kept as versions: segments of changed rows and a manifest.

A commit writes only what changed, as one new segment per table, laid out by a hash
bucket of the uid. A manifest names the segments of each bucket, oldest first, with
the rows and the range of uids they hold, the key/value entries, and the last batch
of every stream. Writing the next manifest is the one step that makes a commit
visible, and fails if somebody else has written it, so a commit that ends early
leaves nothing but unused files. A reader sees one version whatever is written
meanwhile.

The newest row of a uid counts. Buckets that hold many segments are merged, bucket by
bucket; all others stay as they are.

The manifest is read by the driver: its size is buckets times ``MAX_SEGMENTS``,
whatever the number of messages.
"""

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.schema import EMAILS_SCHEMA, KV_SCHEMA, VECTORS_SCHEMA

SCHEMAS = {"emails": EMAILS_SCHEMA, "vectors": VECTORS_SCHEMA}
BUCKETS = 64
#: A bucket with more segments is merged by the next commit that touches it.
MAX_SEGMENTS = 8
COMMIT = "commit"


@dataclass(frozen=True)
class Segment:
    path: str
    rows: int
    low: str
    high: str


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    buckets: int = BUCKETS
    entries: dict[str, str] = field(default_factory=dict)
    #: The last batch that was committed, by the name of its stream.
    batches: dict[str, int] = field(default_factory=dict)
    #: Table -> bucket -> segments, oldest first.
    tables: dict[str, dict[int, tuple[Segment, ...]]] = field(default_factory=lambda: {t: {} for t in SCHEMAS})

    def to_json(self) -> str:
        tables = {
            table: {str(bucket): [vars(s) for s in segments] for bucket, segments in sorted(buckets.items())}
            for table, buckets in self.tables.items()
        }
        return json.dumps({**vars(self), "tables": tables})

    @staticmethod
    def from_json(text: str) -> "Manifest":
        value = json.loads(text)
        value["tables"] = {
            table: {int(bucket): tuple(Segment(**s) for s in segments) for bucket, segments in buckets.items()}
            for table, buckets in value["tables"].items()
        }
        return Manifest(**value)


class CommitConflict(RuntimeError):
    """Another commit made the version this one would have made."""


def bucket_of(uid: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(uid), F.lit(buckets)).cast("int")


# Manifests


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest_path(folder: str, version: int) -> str:
    return f"{folder}/manifest/{version:012d}.json"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that can be read, oldest first."""
    path, files = _hadoop(spark, f"{folder}/manifest/*.json")
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in files.globStatus(path) or [])


def read_manifest(spark: SparkSession, folder: str, version: int | None = None) -> Manifest:
    """A version, the newest by default; before the first commit an empty one."""
    known = versions(spark, folder)
    if version is None and not known:
        return Manifest()
    if version is not None and version not in known:
        raise ValueError(f"no version {version} in {folder}")
    path = _manifest_path(folder, known[-1] if version is None else version)
    return Manifest.from_json(spark.read.text(path, wholetext=True).first()[0])


def publish(spark: SparkSession, folder: str, manifest: Manifest) -> Manifest:
    """Make a manifest the newest version; an error if that version is there."""
    jvm, java = spark.sparkContext._jvm, spark.sparkContext._jsc
    target, files = _hadoop(spark, _manifest_path(folder, manifest.version))
    draft = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(manifest.to_json().encode()))
    out.close()
    # This rename, unlike that of a file system, never replaces a file.
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), java.hadoopConfiguration())
    try:
        context.rename(draft, target, options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            raise CommitConflict(f"version {manifest.version} of {folder} was made by another commit") from error
        raise
    return manifest


# Segments


def _written(spark: SparkSession, folder: str, table: str, rows: DataFrame, manifest: Manifest) -> dict[int, Segment]:
    """Write rows, of unique uids, as a segment; what it holds, by bucket."""
    path = f"{folder}/{table}/{manifest.version:012d}-{uuid.uuid4().hex[:8]}"
    names = SCHEMAS[table].names
    laid = rows.select(*names, F.lit(manifest.version).cast("bigint").alias(COMMIT)).withColumn(
        "bucket", bucket_of(F.col("uid"), manifest.buckets)
    )
    # Buckets of a small change share files' tasks; a big one is split.
    laid.hint("rebalance", "bucket").sortWithinPartitions("bucket", "uid").write.partitionBy("bucket").option(
        "parquet.bloom.filter.enabled#uid", "true"
    ).parquet(path)
    schema = T.StructType([T.StructField("uid", T.StringType()), T.StructField("bucket", T.IntegerType())])
    found = spark.read.schema(schema).parquet(path).groupBy("bucket").agg(
        F.count("*").alias("rows"), F.min("uid").alias("low"), F.max("uid").alias("high")
    )
    # At most one row a bucket.
    return {r.bucket: Segment(f"{path}/bucket={r.bucket}", r.rows, r.low, r.high) for r in found.collect()}


def _segments(spark: SparkSession, table: str, paths: list[str]) -> DataFrame:
    schema = T.StructType([*SCHEMAS[table].fields, T.StructField(COMMIT, T.LongType())])
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def read_table(spark: SparkSession, manifest: Manifest, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
    """The current rows of a table, of all buckets or of some.

    First segments are read as they are, without the uids that later ones hold; of
    those, the newest commit of each uid is found by key before rows are joined.
    """
    wanted = manifest.tables[table]
    chosen = [wanted[b] for b in sorted(wanted if buckets is None else set(buckets) & wanted.keys())]
    base = _segments(spark, table, [segments[0].path for segments in chosen])
    later = [s.path for segments in chosen for s in segments[1:]]
    if not later:
        return base.drop(COMMIT)
    deltas = _segments(spark, table, later)
    newest = deltas.groupBy("uid").agg(F.max(COMMIT).alias(COMMIT))
    kept = base.join(newest.select("uid"), "uid", "left_anti")
    return kept.unionByName(deltas.join(newest, ["uid", COMMIT], "left_semi")).select(*SCHEMAS[table].names)


def lookup(spark: SparkSession, manifest: Manifest, table: str, uid: str) -> DataFrame:
    """The row of one uid, from the segments that may hold it."""
    bucket = spark.range(1).select(bucket_of(F.lit(uid), manifest.buckets)).first()[0]
    segments = tuple(s for s in manifest.tables[table].get(bucket, ()) if s.low <= uid <= s.high)
    if not segments:
        return spark.createDataFrame([], SCHEMAS[table])
    narrowed = replace(manifest, tables={**manifest.tables, table: {bucket: segments}})
    return read_table(spark, narrowed, table).where(F.col("uid") == uid)


def entries(spark: SparkSession, manifest: Manifest) -> DataFrame:
    return spark.createDataFrame(sorted(manifest.entries.items()), KV_SCHEMA)


# Commits


def commit(
    spark: SparkSession, folder: str, parent: Manifest, changes: dict[str, DataFrame], entries: dict[str, str],
    reset: Iterable[str] = (), batch: tuple[str, int] | None = None,
) -> Manifest:
    """The next version: ``changes`` added, the tables in ``reset`` emptied before.

    ``changes`` have one row a uid; rows of the state with these uids are replaced.
    """
    new = replace(
        parent, version=parent.version + 1, entries=dict(entries),
        batches=parent.batches | (dict([batch]) if batch else {}),
        tables={t: {} if t in reset else dict(buckets) for t, buckets in parent.tables.items()},
    )
    for table, rows in changes.items():
        held = new.tables[table]
        for bucket, segment in _written(spark, folder, table, rows, new).items():
            held[bucket] = (*held.get(bucket, ()), segment)
    return publish(spark, folder, _merged(spark, folder, new))


def _merged(spark: SparkSession, folder: str, manifest: Manifest, limit: int | None = None) -> Manifest:
    """Merge the segments of each bucket that has more than ``limit`` of them."""
    limit = MAX_SEGMENTS if limit is None else limit
    tables = {t: dict(buckets) for t, buckets in manifest.tables.items()}
    for table, held in tables.items():
        full = [b for b, segments in held.items() if len(segments) > limit]
        if full:
            rows = read_table(spark, manifest, table, full)
            held.update({b: (s,) for b, s in _written(spark, folder, table, rows, manifest).items()})
    return replace(manifest, tables=tables)


def compact(spark: SparkSession, folder: str, limit: int = 1) -> Manifest:
    """A version of the same rows with at most ``limit`` segments a bucket."""
    parent = read_manifest(spark, folder)
    return publish(spark, folder, _merged(spark, folder, replace(parent, version=parent.version + 1), limit))


def cleared(spark: SparkSession, folder: str, tables: Iterable[str]) -> Manifest:
    """A version in which some tables are empty, such as the vectors before they are built again."""
    parent = read_manifest(spark, folder)
    return commit(spark, folder, parent, {}, parent.entries, reset=tables)


def expire(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Remove all versions but the newest ``keep`` and the segments only they name.

    Segments of a commit under way have the number of a version to come and stay.
    """
    known = versions(spark, folder)
    named, newest = set(), known[-1] if known else 0
    for version in known[-keep:]:
        for buckets in read_manifest(spark, folder, version).tables.values():
            named |= {s.path.rsplit("/", 1)[0].rsplit("/", 1)[1] for segments in buckets.values() for s in segments}
    for version in known[:-keep]:
        path, files = _hadoop(spark, _manifest_path(folder, version))
        files.delete(path, False)
    for table in SCHEMAS:
        path, files = _hadoop(spark, f"{folder}/{table}/*")
        for status in files.globStatus(path) or []:
            name = status.getPath().getName()
            if name not in named and int(name.split("-")[0]) <= newest:
                files.delete(status.getPath(), True)
