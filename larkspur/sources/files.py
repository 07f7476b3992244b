"""Text sources: files, lines, documents, locale and lock files, DDL dumps, table statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.graph import cut
from larkspur.operators.predicates import SENSITIVE_GLOBS, is_sensitive_path

TOPIC_SCHEMA = "id string, title string, source string, summary string, keywords array<string>, category string, path string"


def files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int = 1_048_576, sensitive: tuple[str, ...] = SENSITIVE_GLOBS) -> DataFrame:
    """path, length, modified and content of the files below path; too large and sensitive ones are left out, bad bytes replaced."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    kept = raw.where((F.col("length") <= most_bytes) & ~is_sensitive_path(F.col("path"), sensitive))
    return kept.select("path", "length", F.col("modificationTime").alias("modified"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def lines(found: DataFrame, text: str = "content", key: str = "path") -> DataFrame:
    """key, line_number (from 1) and content of every line."""
    return found.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "content")).select(key, (F.col("pos") + 1).alias("line_number"), "content")


def topics(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of document topics."""
    return spark.read.schema(TOPIC_SCHEMA).json(path, multiLine=True)


def locked_versions(numbered: DataFrame, partition: str, line: str, order: str) -> DataFrame:
    """name, version and section of a lock file's entries: indented ``name (version)`` lines below an upper-case section; a platform after a dash is dropped."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    section = F.when(F.col(line).rlike(r"^[A-Z][A-Z ]*$"), F.col(line))
    marked = numbered.withColumn("section", F.last(section, ignorenulls=True).over(w))
    name, version = F.regexp_extract(line, r"^ {4}(\S+) \(([^)]+)\)$", 1), F.regexp_extract(line, r"^ {4}(\S+) \(([^)]+)\)$", 2)
    return marked.where(name != "").select(partition, "section", name.alias("name"), F.substring_index(version, "-", 1).alias("version"))


def locale_keys(rows: DataFrame, locale: str, document: str) -> DataFrame:
    """Dotted keys of nested JSON documents, however deep; an empty map has no keys. Each level is kept, so the plan does not grow with the depth."""
    level = rows.select(F.col(locale).alias("locale"), F.lit("").alias("key"), F.parse_json(document).alias("doc"))
    out = None
    while True:
        inner = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("doc").outer()).select(F.col("key").alias("k"), "value")).where("k IS NOT NULL")
        key = F.concat(F.when(F.col("key") == "", "").otherwise(F.concat("key", F.lit("."))), "k")
        inner = cut(inner.select("locale", key.alias("key"), F.schema_of_variant("value").startswith("OBJECT").alias("deeper"), F.to_json("value").alias("doc")))
        leaves = inner.where("not deeper").select("locale", "key")
        out = leaves if out is None else out.unionByName(leaves)
        level = inner.where("deeper").select("locale", "key", F.parse_json("doc").alias("doc"))
        if level.isEmpty():
            return out


def resolved_paths(paths: DataFrame, links: DataFrame, most_links: int = 40) -> DataFrame:
    """paths (path, absolute) with real, where it leads once the links (link, target) on its way are followed, or null if that comes back to where it was, or after most_links of them.

    Like a file system this goes from the left: a link is followed, and ``..`` goes up from where the part before it really is. Targets are
    absolute or relative to the link's folder. A round follows one link of every path that still has one.
    """
    on_way = links.select(F.col("link").alias("_prefix"), F.col("target").alias("_target")).dropna().dropDuplicates(["_prefix"])
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))
    at = paths.where("path IS NOT NULL").select("path").distinct().select("path", parts(F.col("path")).alias("_p"), F.array().cast("array<string>").alias("_seen"))
    done = None
    while True:
        up = F.array_position("_p", "..")
        head = F.when(up > 0, F.slice("_p", 1, (up - 1).cast("int"))).otherwise(F.col("_p"))
        prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(head), F.lit(1))), lambda n: F.struct(n.alias("n"), F.concat(F.lit("/"), F.array_join(F.slice(head, 1, n), "/")).alias("prefix")))
        met = at.select("path", F.explode(prefixes).alias("x")).join(on_way, F.col("x.prefix") == F.col("_prefix"))
        first = met.groupBy("path").agg(F.min_by(F.struct("x.n", "_target"), "x.n").alias("_hit"))
        rest = F.slice("_p", F.col("_hit.n") + 1, F.size("_p"))
        folder = F.when(F.col("_hit._target").startswith("/"), F.array().cast("array<string>")).otherwise(F.slice("_p", F.lit(1), F.col("_hit.n") - 1))
        above = F.concat(F.slice("_p", F.lit(1), F.greatest(up - 2, F.lit(0)).cast("int")), F.slice("_p", (up + 1).cast("int"), F.size("_p")))
        moved = at.join(first, "path", "left").select(
            "path",
            F.when(F.col("_hit").isNotNull(), F.concat(folder, parts(F.col("_hit._target")), rest)).when(up > 0, above).otherwise(F.col("_p")).alias("_p"),
            F.when(F.col("_hit").isNotNull(), F.concat("_seen", F.array(F.array_join("_p", "/")))).otherwise(F.col("_seen")).alias("_seen"),
            (F.col("_hit").isNull() & (up == 0)).alias("_rests"),
        )
        moved = cut(moved.withColumn("_round", (F.size("_seen") > most_links) | F.array_contains("_seen", F.array_join("_p", "/"))))
        ended = moved.where("_rests OR _round").select("path", F.when(F.col("_rests"), F.concat(F.lit("/"), F.array_join("_p", "/"))).alias("real"))
        done = ended if done is None else done.unionByName(ended)
        at = moved.where("NOT _rests AND NOT _round").select("path", "_p", "_seen")
        if at.isEmpty():
            return paths.join(done, "path", "left")


def contained(paths: DataFrame, links: DataFrame, root: str, sensitive: tuple[str, ...] = SENSITIVE_GLOBS) -> DataFrame:
    """The paths whose real place is below root, itself without links, and not sensitive there, with that place (real). Loops are dropped."""
    root = "/" + root.strip("/")
    inner = F.substring("real", len(root) + 2, 1_000_000)
    return resolved_paths(paths, links).where((F.col("real") == root) | (F.col("real").startswith(f"{root}/") & ~is_sensitive_path(inner, sensitive)))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modified of the files below path, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of each table folder or file below sf_dir."""
    name = F.regexp_extract("path", r"/([^/]+)\.parquet(?:/|$)", 1)
    return listing(spark, sf_dir).groupBy(name.alias("table")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def row_counts(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """Rows of each table, from the footers of their files."""
    out = None
    for name in names:
        one = spark.read.parquet(f"{sf_dir}/{name}.parquet").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def fingerprint(found: DataFrame) -> DataFrame:
    """One digest of paths, times and lengths: a renamed, changed or resized file changes it. Sums of hashes need no order and no list of files."""
    parts = [F.xxhash64(F.lit(seed), "path", "modified", "length") for seed in range(4)]
    sums = found.select(*(p.alias(f"h{i}") for i, p in enumerate(parts))).agg(F.count("*").alias("n"), *(F.sum(F.col(f"h{i}").cast("decimal(20, 0)")).alias(f"s{i}") for i in range(4)))
    return sums.select(F.sha2(F.concat_ws(",", *(F.col(c).cast("string") for c in sums.columns)), 256).alias("fingerprint"))


def catalog_columns(spark: SparkSession) -> DataFrame:
    """table, position, name, type and nullable of the session's views and tables."""
    rows = [(t.name, i, f.name, f.dataType.simpleString(), f.nullable) for t in spark.catalog.listTables() for i, f in enumerate(spark.table(t.name).schema)]
    return spark.createDataFrame(rows, "table string, position int, name string, type string, nullable boolean")
