"""Reading contract files, AST and graph documents, dataset indexes; merging and writing results; error and directory reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from randaudit.functions.text_rules import decode_bytes, normalise_newlines
from randaudit.sources import named_files


FILES = named_files.FILES


def _files(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """path, content of all files of a pattern below a folder, or below several; none of them gives no rows.

    Spark lists them on the driver, so this is for folders from elsewhere; what named_files wrote is read by named_files.read().
    """
    if not path:
        return spark.createDataFrame([], FILES)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return found.load(path).select("path", "content")


def read_contracts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """contract_id (file stem), batch, label (1 below a folder `vulnerable`, 0 below `safe`), path, code, encoding of all .sol files.

    encoding tells how broken bytes were read: ISO-8859-1 where they are no valid UTF-8.
    Spark's reader leaves out files of no bytes, which have nothing to scan.
    """
    return from_bytes(_files(spark, path, "*.sol"))


def from_bytes(files: DataFrame) -> DataFrame:
    """The same from (path, content); positions later count characters after line ends became line feeds."""
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    return files.select(
        F.regexp_extract("path", r"([^/]*)\.sol$", 1).alias("contract_id"),
        F.regexp_extract("path", r"([^/]*)/[^/]*/[^/]*$", 1).alias("batch"),
        F.when(folder == "vulnerable", 1).when(folder == "safe", 0).alias("label"),
        "path",
        normalise_newlines(decode_bytes(F.col("content"))).alias("code"),
        F.when(F.is_valid_utf8(F.col("content").cast("string")), "UTF-8").otherwise("ISO-8859-1").alias("encoding"),
    )


def read_asts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, file_name, ast (variant), status of AST documents, a JSON object a file (S3).

    status is `read`, `broken` (no JSON: ast is null) or `no object` (JSON of another kind); bytes that are no UTF-8 are read as ISO-8859-1.
    """
    return asts_from_bytes(_files(spark, path, "*.json"))


def asts_from_bytes(files: DataFrame) -> DataFrame:
    """The same from (path, content)."""
    docs = files.select("path", decode_bytes(F.col("content")).alias("json"))
    return parse_asts(docs).withColumn("status", ast_status())


def ast_status() -> Column:
    """How a document of parse_asts() was read."""
    is_object = F.try_variant_get("ast", "$", "map<string,variant>").isNotNull()
    return F.when(F.col("ast").isNull(), "broken").when(is_object, "read").otherwise("no object")


def with_missing(listed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of a list of files with what was found of each; status is `missing` where nothing was.

    found may tell a status of its own; without one, what was found counts as `read`. Empty files count as missing.
    """
    told = found if "status" in found.columns else found.withColumn("status", F.lit("read"))
    return listed.join(told, key, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def parse_asts(docs: DataFrame) -> DataFrame:
    """path, file_name, ast from (path, json); a document without file_name is named after its file."""
    ast = docs.select("path", F.try_parse_json("json").alias("ast"))
    stem = F.concat(F.regexp_extract("path", r"([^/]*?)(\.json)?$", 1), F.lit(".sol"))
    return ast.select("path", F.coalesce(F.try_variant_get("ast", "$.file_name", "string"), stem).alias("file_name"), "ast")


_TEXT = T.StringType()
GRAPH = T.StructType(
    [
        T.StructField(
            "nodes",
            T.ArrayType(
                T.StructType(
                    [T.StructField(n, _TEXT) for n in ("id", "label", "type", "code_snippet")]
                    + [T.StructField(n, T.BooleanType()) for n in ("is_source", "is_sink")]
                    + [T.StructField(n, T.ArrayType(_TEXT)) for n in ("sources", "sinks", "used_vars", "defined_vars")]
                )
            ),
        ),
        T.StructField("edges", T.ArrayType(T.StructType([T.StructField(n, _TEXT) for n in ("source", "target", "type", "var")]))),
    ]
)


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all *_semantic_graph.json files; the contract is the file name without that suffix."""
    docs = spark.read.schema(GRAPH).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*_semantic_graph.json")
    named = docs.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)_semantic_graph\.json$", 1).alias("contract_id"), "nodes", "edges")
    return explode_graphs(named)


def explode_graphs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from (contract_id, nodes[], edges[]); edges carry ord, their place in the document."""
    nodes = docs.select("contract_id", F.explode("nodes").alias("n")).select("contract_id", "n.*")
    edges = docs.select("contract_id", F.posexplode("edges").alias("ord", "e")).select("contract_id", "e.*", "ord")
    return nodes, edges


INDEX = "entries array<struct<contract_id:string,label:int,num_paths:bigint>>"


def read_index(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """contract_id, label, num_paths, batch of the index files by batch name; a batch without a file is skipped."""
    out = spark.createDataFrame([], "contract_id string, label int, num_paths bigint, batch string")
    for batch, path in paths.items():  # a handful of batches
        docs = spark.read.schema(INDEX).option("ignoreMissingFiles", True).option("multiLine", True)
        try:
            found = docs.json(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = out.unionByName(found.select(F.explode("entries").alias("e")).select("e.*", F.lit(batch).alias("batch")))
    return out


def write_results(results: DataFrame, path: str) -> None:
    """A record for each contract, by batch, as JSON lines; an existing output is never overwritten."""
    results.write.partitionBy("batch").json(path)


#: Characters of code whose hits stand in one part of a merged document.
SPAN = 65_536


def source_entry() -> Column:
    """A hit as it stands in a merged document."""
    return F.struct(
        F.col("node_id").alias("nodeId"),
        F.col("source_type").alias("sourceType"),
        "pattern",
        "position",
        F.col("matched_text").alias("matchedText"),
        F.struct(F.col("context_type").alias("type"), F.col("context_name").alias("name"), "snippet").alias("context"),
        F.col("risk_level").alias("riskLevel"),
        F.col("contextual_risk").alias("taintLevel"),
        F.col("base_risk").alias("baseRisk"),
        F.col("contextual_risk").alias("contextualRisk"),
        F.col("usage_context").alias("usageContext"),
        F.col("cwe").alias("cweMapping"),
        "description",
        F.col("is_nested").alias("isNested"),
        F.col("risk_factors").alias("riskFactors"),
        F.lit(True).alias("isSource"),
    )


def source_parts(hits: DataFrame, *keys: str, span: int = SPAN) -> DataFrame:
    """keys, part, entries: the hits of a contract by spans of its code, in order of place, kind and id.

    A part holds the hits that start in `span` characters, so neither an array nor a task grows with the number of hits of a contract.
    """
    ordered = F.struct("position", "kind", "node_id", source_entry().alias("entry"))
    grouped = hits.groupBy(*keys, F.floor(F.col("position") / span).alias("part")).agg(F.sort_array(F.collect_list(ordered)).alias("found"))
    return grouped.select(*keys, "part", F.transform("found", lambda x: x["entry"]).alias("entries"))


def _edited(ast: str, **fields: Column) -> Column:
    """A variant object as JSON text, with fields set to new values; all others stay."""
    own = F.map_filter(F.try_variant_get(ast, "$", "map<string,variant>"), lambda k, v: ~k.isin(*fields))
    new = F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), value)])
    return F.to_json(F.map_concat(own, new))


def merge_sources(asts: DataFrame, hits: DataFrame, summary: DataFrame, span: int = SPAN) -> DataFrame:
    """path, file_name, part, n_parts, json: AST documents with the `sources` and the `sourcesSummary` of their contract.

    asts are (path, file_name, ast); hits and summary (as statistics() gives it) carry file_name. Part 0 is the whole document with the hits of
    the first `span` characters of code; what follows are parts of file_name, part and further sources. Both fields replace what the document
    had under these names. A contract without hits has no sources and a summary of zeros. A document that is no JSON object is left out.
    """
    parts = source_parts(hits, "file_name", span=span)
    last = parts.groupBy("file_name").agg(F.max("part").alias("last"))
    empty = F.array().cast(parts.schema["entries"].dataType)
    whole = asts.where(ast_status() == "read").select("path", "file_name", "ast")
    whole = whole.join(last, "file_name", "left").join(summary, "file_name", "left").join(parts.where("part = 0").drop("part"), "file_name", "left")
    zero = F.lit(0).cast("long")
    counts = F.struct(
        F.coalesce("total_sources", zero).alias("total_sources"),
        F.coalesce("by_type", F.create_map().cast("map<string,bigint>")).alias("by_type"),
        F.coalesce("by_risk", F.create_map().cast("map<string,bigint>")).alias("by_risk"),
        F.coalesce("nested_sources", zero).alias("nested_sources"),
    )
    n_parts = (F.coalesce("last", zero) + 1).alias("n_parts")
    edited = _edited("ast", sources=F.to_variant_object(F.coalesce("entries", empty)), sourcesSummary=F.to_variant_object(counts))
    heads = whole.select("path", "file_name", zero.alias("part"), n_parts, edited.alias("json"))
    more = asts.where(ast_status() == "read").select("path", "file_name").join(last, "file_name").join(parts.where("part > 0"), "file_name")
    rest = more.select("path", "file_name", "part", n_parts, F.to_json(F.struct("file_name", "part", F.col("entries").alias("sources"))).alias("json"))
    return heads.unionByName(rest)


def write_merged(merged: DataFrame, path: str) -> None:
    """Merged documents as named files of the next version: <folder>/<stem>.json, further parts as <stem>.<part>.json. Inputs stay as they are."""
    stem = F.regexp_extract("path", r"([^/]*/)?([^/]*?)(\.json)?$", 0)
    name = F.concat(F.regexp_replace(stem, r"\.json$", ""), F.when(F.col("part") > 0, F.concat(F.lit("."), F.col("part"))).otherwise(""), F.lit(".json"))
    named_files.write(merged.select(name.alias("name"), F.encode("json", "UTF-8").alias("content")), path)


def read_merged(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """path, file_name, ast, status, part of the documents of a version, the last by default."""
    found = asts_from_bytes(named_files.read(spark, path, version, "*.json"))
    return found.withColumn("part", F.coalesce(F.try_variant_get("ast", "$.part", "long"), F.lit(0)))


def error_report(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(errors, counts) of attempts (file, version, error, null for success): the failed ones, and rows by status."""
    told = attempts.withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("error"))
    return told.where("status = 'error'").select("file", "error", "version"), told.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def directory_profile(files: DataFrame, shown: int = 5) -> DataFrame:
    """directory, n_items, n_contracts, sample (the first names), more (how many others) from (directory, name)."""
    from pyspark.sql import Window

    first = Window.partitionBy("directory").orderBy("name")
    contract = F.col("name").endswith(".sol")
    counts = files.groupBy("directory").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(contract).alias("n_contracts"))
    top = files.where(contract).withColumn("k", F.row_number().over(first)).where(F.col("k") <= shown)
    samples = top.groupBy("directory").agg(F.sort_array(F.collect_list("name")).alias("sample"))
    more = F.greatest(F.col("n_contracts") - shown, F.lit(0))
    return counts.join(samples, "directory", "left").select("directory", "n_items", "n_contracts", F.coalesce("sample", F.array().cast("array<string>")).alias("sample"), more.alias("more"))
