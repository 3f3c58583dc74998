"""A mailbox that has landed as files, read from where the last round stopped.

Layout: root/<folder in modified UTF-7>/<uidvalidity>/<number>_uid<uid>_<subject>.eml. The cursor is (uidvalidity, uid) of each
folder, in the state table `mailbox_sync`, not a list of file names: a new validity starts the folder over, as its uids say
nothing about the old ones. Listing opens no file; dates are compared while listing, uids and validities on the listed names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailglass.functions.names import folder_decoded, folder_encoded, safe_file_name
from mailglass.sources.mail import MAX_BYTES, parse_mails
from mailglass.sources.state_tables import StateTables

PER_ROUND = 200


def landing_path(folder: Column, uidvalidity: Column, index: Column, uid: Column, subject: Column) -> Column:
    """Where below the root a fetched mail lands."""
    name = F.concat(F.lpad(index.cast("string"), 5, "0"), F.lit("_uid"), uid.cast("string"), F.lit("_"), safe_file_name(subject, F.lit("mail")), F.lit(".eml"))
    # A folder's name may hold slashes, which base64 of this kind has not; a plain one becomes a colon.
    return F.concat_ws("/", F.translate(folder_encoded(folder), "/", ":"), uidvalidity.cast("string"), name)


def listed(spark: SparkSession, root: str, since: str | None = None, before: str | None = None) -> DataFrame:
    """path, folder, uidvalidity, uid, modificationTime, length of the landed mails of each folder's newest validity; nothing
    is opened. since, before: moments (yyyy-MM-ddTHH:mm:ss, of the session's zone) between which files were last changed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true")
    for option, value in (("modifiedAfter", since), ("modifiedBefore", before)):
        files = files.option(option, value) if value else files
    parts = F.split(F.col("path"), "/")
    x = files.load(root).select("path", folder_decoded(F.translate(F.url_decode(F.element_at(parts, -3)), ":", "/")).alias("folder"), F.element_at(parts, -2).try_cast("long").alias("uidvalidity"), F.regexp_extract(F.element_at(parts, -1), r"_uid(\d+)_", 1).try_cast("long").alias("uid"), "modificationTime", "length")
    newest = F.max("uidvalidity").over(Window.partitionBy("folder"))
    return x.filter("uid is not null and uidvalidity is not null").withColumn("_newest", newest).filter("uidvalidity = _newest").drop("_newest")


def not_fetched(files: DataFrame, cursor: DataFrame) -> DataFrame:
    """Of listed files those beyond their folder's cursor: of a greater uid, or all where the validity is another."""
    c = cursor.select("folder", F.col("uidvalidity").alias("_validity"), F.col("last_uid").alias("_last"))
    beyond = F.col("_last").isNull() | (F.col("_validity") != F.col("uidvalidity")) | (F.col("uid") > F.col("_last"))
    return files.join(c, "folder", "left").filter(beyond).drop("_validity", "_last")


def mails_of(spark: SparkSession, files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Listed files as mails, with folder, uidvalidity and uid; only these files are opened. Their names come to the driver, so
    `files` is a round of bounded size. Larger ones than max_bytes are not opened and keep path and size only."""
    paths = [r.path for r in files.filter(F.col("length") <= max_bytes).select("path").collect()]
    own = files.select("path", "folder", "uidvalidity", "uid", "length")
    raw = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path string, content binary")
    parsed = own.drop("length").join(parse_mails(raw), "path")
    large = own.filter(F.col("length") > max_bytes).withColumnRenamed("length", "raw_size")
    return parsed.unionByName(large, allowMissingColumns=True)


def fetch_round(tables: StateTables, root: str, on_mails: Callable[[DataFrame], None], per_round: int = PER_ROUND, now: Column | None = None) -> int:
    """Hands the next mails of every folder (at most per_round each, the smallest uids first) to on_mails, then moves the cursors
    and returns how many mails they were. If on_mails fails, no cursor moves and the same mails come again."""
    base = tables.manifest()["version"]
    cursor = tables.read("mailbox_sync", base)
    by = Window.partitionBy("folder").orderBy("uid", "path")
    todo = not_fetched(listed(tables.spark, root), cursor).withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= per_round).drop("_n").persist()
    try:
        n = todo.count()
        if n:
            on_mails(mails_of(tables.spark, todo))
            moved = todo.groupBy("folder").agg(F.max("uidvalidity").alias("uidvalidity"), F.max("uid").alias("last_uid")).withColumn("last_sync", F.current_timestamp() if now is None else now)
            tables.commit({"mailbox_sync": cursor.join(moved.select("folder"), "folder", "left_anti").unionByName(moved)}, base)
        return n
    finally:
        todo.unpersist()


def read_range(spark: SparkSession, root: str, since: str | None = None, before: str | None = None, first_uid: int = 0) -> DataFrame:
    """The mails of a range of dates and uids; no cursor is read or moved."""
    return mails_of(spark, listed(spark, root, since, before).filter(F.col("uid") >= first_uid))
