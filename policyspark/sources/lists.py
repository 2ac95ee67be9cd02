"""Readers and writers of lists, events and logs.  Network access isn't part of it: sources are landed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.domains import is_ip_literal
from ..functions.fence import fenced
from ..functions.joins import side

HOSTS, PLAIN = "hosts", "plain"

SCAN_EVENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("windowTitle", T.StringType()), T.StructField("at", T.StringType())])


def read_lines(spark: SparkSession, path: str, source: str, category: str, fmt: str) -> DataFrame:
    """Lines of a list file: source, category, format, value."""
    return spark.read.text(path).select(F.lit(source).alias("source"), F.lit(category).alias("category"), F.lit(fmt).alias("format"), "value")


def read_category_dirs(spark: SparkSession, root: str, source: str) -> DataFrame:
    """``root``/<category>/domains, files or folders of part files; the category is the directory's name."""
    files = _category_files(spark, root, "domains")
    return files.select(F.lit(source).alias("source"), "category", F.lit(PLAIN).alias("format"), "value")


def read_urls_entries(spark: SparkSession, root: str) -> DataFrame:
    """value of the lines of ``root``/<category>/urls, which are only counted."""
    return _category_files(spark, root, "urls").select("value")


def _category_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).text(root).select("value", F.regexp_extract("_metadata.file_path", f"/([^/]+)/{name}(?:/part-[^/]*)?$", 1).alias("category"))
    return files.where("category <> ''")


def count_urls_entries(lines: DataFrame) -> DataFrame:
    """How many lines of ``urls`` files are left out."""
    return lines.where(F.trim(F.regexp_replace("value", "#.*", "")) != "").agg(F.count("*").alias("n_urls"))


def read_param_list(spark: SparkSession, path: str) -> DataFrame:
    """value of every line that isn't blank or a comment."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("value")).where("value <> ''")


def tagged_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (source, category, format, value) with outcome, domain and scope_hint.

    outcome: blank (also comments), malformed, ip_literal or entry; one each, in this order.
    """
    df = fenced(lines, __t=F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), "(?s)#.*", "")))
    fields = F.split("__t", r"\s+")
    df = fenced(df, __f=F.when(F.col("format") == HOSTS, F.get(fields, F.lit(1))).otherwise(F.get(fields, F.lit(0))))
    wild = F.col("__f").rlike(r"^\*\..+")
    df = fenced(df, domain=F.when(wild, F.substr("__f", F.lit(3))).otherwise(F.col("__f")), scope_hint=F.when(wild, "apex").otherwise("none"))
    outcome = F.when(F.col("__t") == "", "blank").when(F.col("domain").isNull(), "malformed").when(is_ip_literal(F.col("domain")), "ip_literal").otherwise("entry")
    return df.withColumn("outcome", outcome).drop("__t", "__f")


def raw_entries(lines: DataFrame) -> DataFrame:
    """domain, source, category, scope_hint of the lines that are entries."""
    return tagged_lines(lines).where("outcome = 'entry'").select("domain", "source", "category", "scope_hint")


def parse_report(lines: DataFrame) -> DataFrame:
    """source, outcome, n; outcome wildcard counts entries with an apex hint besides."""
    t = tagged_lines(lines)
    outcomes = F.explode(F.when((F.col("outcome") == "entry") & (F.col("scope_hint") == "apex"), F.array(F.lit("entry"), F.lit("wildcard"))).otherwise(F.array("outcome"))).alias("outcome")
    return t.select("source", outcomes).groupBy("source", "outcome").agg(F.count("*").alias("n"))


def user_blocklist(lines: DataFrame) -> DataFrame:
    """Distinct plausible domains of a user's list (value, line_no), first line of each; others are dropped."""
    name = F.lower(F.regexp_replace(F.trim(F.regexp_replace("value", "#.*", "")), r"\.$", ""))
    labels = F.split("domain", r"\.")
    fine = (F.col("domain") != "") & ~F.col("domain").rlike(r"[\s/:@]") & F.forall(labels, lambda x: F.length(x).between(1, 63)) & (F.length("domain") <= 253)
    return lines.select(name.alias("domain"), "line_no").where(fine).groupBy("domain").agg(F.min("line_no").alias("line_no"))


def admission(snapshots: DataFrame, expected: DataFrame, allowed: DataFrame) -> DataFrame:
    """``snapshots`` (source, revision, license) with admission: the first failed check, else admitted."""
    spdx = lambda c: F.lower(F.trim(c))
    e = expected.select("source", F.col("revision").alias("pinned"), F.col("license").alias("known"))
    ok = allowed.select(spdx(F.col("value")).alias("ok")).distinct()
    joined = snapshots.join(e.hint("merge"), "source", "left").join(side(ok), spdx(F.col("license")) == F.col("ok"), "left")
    why = F.when(F.col("pinned").isNotNull() & (F.col("revision") != F.col("pinned")), "revision_mismatch").when(F.col("known").isNotNull() & (spdx(F.col("license")) != spdx(F.col("known"))), "license_changed").when(F.col("ok").isNull(), "license_not_allowed").otherwise("admitted")
    return joined.select(*snapshots.columns, why.alias("admission"))


def scan_events(lines: DataFrame) -> DataFrame:
    """Well-shaped scan events of NDJSON lines (value), batch or stream; others are skipped."""
    e = lines.select(F.from_json("value", SCAN_EVENT).alias("e")).select("e.*")
    return e.where(F.col("type").isNotNull() & F.col("verdict").isin("allow", "warn", "block") & F.col("score").isNotNull() & F.col("windowTitle").isNotNull() & F.col("at").isNotNull())


def tamper_line(wall: Column, elapsed: Column, event: Column, detail: Column) -> Column:
    """A log line; control characters of the detail become blanks and it is cut at 120 characters."""
    clean = F.left(F.regexp_replace(F.coalesce(detail, F.lit("")), r"[\x00-\x1F\x7F]", " "), F.lit(120))
    return F.concat_ws("\t", wall.cast("string"), elapsed.cast("string"), event, clean)


def read_tamper_lines(lines: DataFrame) -> DataFrame:
    """wall_ms, elapsed_ms, event, detail of the lines (value) that parse."""
    p = F.split("value", "\t", 4)
    parsed = lines.select(F.get(p, F.lit(0)).try_cast("long").alias("wall_ms"), F.get(p, F.lit(1)).try_cast("long").alias("elapsed_ms"), F.get(p, F.lit(2)).alias("event"), F.coalesce(F.get(p, F.lit(3)), F.lit("")).alias("detail"))
    return parsed.where("wall_ms is not null and elapsed_ms is not null and event <> ''")


def binary_corpus(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".png", ".jpg", ".jpeg", ".webp")) -> DataFrame:
    """path and content of the images below ``root``; a root without images is an error."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    if df.select("path").isEmpty():
        raise ValueError(f"no images below {root}")
    return df


#: Bodies larger than this pass unscanned; kinds of a video segment by the end of its path.
BODY_LIMIT = 1 << 20
SEGMENTS = {"ts": "transport_stream", "m4s": "fragmented_mp4", "mp4": "fragmented_mp4", "m3u8": "playlist", "mpd": "playlist"}


def segment_kind(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in SEGMENTS.items() for x in kv])
    return kinds[end]


def body_route(path: Column, content_type: Column, size: Column, limit: int = BODY_LIMIT) -> Column:
    """video_segment by path, then too_large, html or image by content type, else pass."""
    return F.when(segment_kind(path).isNotNull(), "video_segment").when(size > limit, "too_large").when(content_type.startswith("text/html"), "html").when(content_type.startswith("image/"), "image").otherwise("pass")
