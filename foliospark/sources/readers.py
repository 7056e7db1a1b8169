"""Readers for document exports, labels, annotations, corpora, side files and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliospark.functions import text as t

DOC_SCHEMA = (
    "type string, filename string, num_pages bigint, metadata string, page_num bigint, width bigint, height bigint, "
    "block_idx bigint, text string, block_type string, bbox array<double>, confidence double, table_idx bigint, "
    "num_cells bigint, dimensions struct<rows:bigint,cols:bigint>, cells array<struct<row:bigint,col:bigint,text:string>>, "
    "text_blocks array<struct<text:string,block_type:string,bbox:array<double>,confidence:double>>, "
    "tables array<struct<num_cells:bigint,cells:array<struct<row:bigint,col:bigint,text:string>>>>, reading_order array<bigint>"
)

DOC_COLUMNS = {
    "document": ["filename", "num_pages", "metadata"],
    "page": ["filename", "page_num", "width", "height", "text_blocks", "tables", "reading_order"],
    "text_block": ["filename", "page_num", "block_idx", "text", "block_type", "bbox", "confidence"],
    "table": ["filename", "page_num", "table_idx", "num_cells", "dimensions", "cells", "bbox"],
}


def read_doc_jsonl(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Typed JSON lines as one table per line type, each with its file; all lines are read, broken ones are left out."""
    raw = spark.read.schema(DOC_SCHEMA + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    lines = raw.withColumn("file", F.input_file_name()).filter(F.col("type").isNotNull())
    return {kind: lines.filter(F.col("type") == kind).select("file", *cols) for kind, cols in DOC_COLUMNS.items()}


DEFAULT_INSTRUCTION = "Extract information from the document."  # fixed value


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """instruction, document, response from JSON lines (.jsonl) or files holding one array each (.json)."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1]
    if suffix not in ("json", "jsonl"):
        raise ValueError(f"unsupported file format: {path}")
    reader = spark.read.schema("instruction string, document string, response string")
    rows = reader.option("multiLine", suffix == "json").json(path)
    rows = rows.filter(F.col("document").isNotNull() | F.col("response").isNotNull())
    return rows.withColumn("instruction", F.coalesce("instruction", F.lit(DEFAULT_INSTRUCTION)))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; a collection of any size is a folder of files."""
    return spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """name, text of files that hold one JSON object {name: text}."""
    return _whole(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "text"))


COCO_SCHEMA = (
    "images array<struct<id:bigint,file_name:string,width:bigint,height:bigint>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, "
    "categories array<struct<id:bigint,name:string>>"
)


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations (as corner boxes with class name, known images only) and categories."""
    doc = spark.read.schema(COCO_SCHEMA).option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.*")
    categories = doc.select(F.explode("categories").alias("c")).select("c.*").distinct()
    ann = doc.select(F.explode("annotations").alias("a")).select("a.*")
    b = F.col("bbox")
    ann = ann.select("id", "image_id", "category_id", b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2"))
    ann = ann.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("label"))
    return {"images": images, "annotations": ann.join(names, "category_id", "left"), "categories": categories}


def read_table_annotations(spark: SparkSession, path: str) -> DataFrame:
    """image, idx, label, cx, cy, w, h from {"annotations": [...]} or a bare list; the name is `image` or `image_path`."""
    item = "array<struct<image:string,image_path:string,boxes:array<array<double>>,labels:array<int>>>"
    whole = _whole(spark, path)
    wrapped = F.from_json("value", f"annotations {item}")["annotations"]
    bare = F.from_json(F.when(F.col("value").rlike(r"^\s*\["), F.col("value")), item)
    rows = whole.select(F.explode(F.coalesce(bare, wrapped)).alias("a"))
    rows = rows.select(F.coalesce("a.image", "a.image_path").alias("image"), F.posexplode(F.arrays_zip("a.boxes", "a.labels")).alias("idx", "z"))
    b = F.col("z.boxes")
    return rows.select("image", "idx", F.col("z.labels").alias("label"), *(b[i].alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))))


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder of text files, NFKC and stripped. A JSON line with a text field gives that field."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    v = F.col("value")
    json_like = F.ltrim(v).startswith("{") & v.contains('"text"')
    body = F.when(json_like & F.try_parse_json(v).isNotNull(), F.coalesce(F.get_json_object(v, "$.text"), F.lit(""))).otherwise(v)
    return lines.select(t.strip(t.nfkc(body)).alias("text")).filter("text <> ''")


def discover_inputs(spark: SparkSession, root: str, exts: list[str], limit: int | None = None) -> DataFrame:
    """path, size, sha256 of the files below a folder with one of the endings, optionally the first by path."""
    globs = "*.{" + ",".join(e.lstrip(".") for e in exts) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", globs).load(root)
    out = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return out.orderBy("path").limit(limit) if limit else out


BASELINE_SCHEMAS = {
    "docqa": "model string, docvqa string, chartqa string, textvqa string, source string",
    "layout": "method string, split string, map string, source string",
    "tables": "method string, dataset string, metric string, score string, source string",
}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm_path)


def read_baselines(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Published numbers per section; a missing file is an empty table."""
    out = {}
    for name, schema in BASELINE_SCHEMAS.items():
        path = f"{root.rstrip('/')}/{name}.csv"
        if path_exists(spark, path):
            out[name] = spark.read.schema(schema).option("header", True).csv(path)
        else:
            out[name] = spark.createDataFrame([], schema)
    return out


def read_eval_logs(spark: SparkSession, path: str) -> DataFrame:
    """trial (the folder name of the log), epoch, step, cer, num; broken lines are left out."""
    rows = spark.read.schema("epoch bigint, step bigint, cer double, num bigint").option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.col("cer").isNotNull()).withColumn("trial", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def consolidated_report(spark: SparkSession, path: str) -> DataFrame:
    """eval, metric, value over all numeric entries of a folder of JSON result files."""
    files = _whole(spark, path).withColumn("v", F.try_parse_json("value")).filter(F.col("v").isNotNull())
    body = F.from_json(F.to_json("v"), "map<string,variant>")
    rows = files.select(F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1).alias("eval"), F.explode(body).alias("metric", "x"))
    number = t.variant_kind(F.col("x")).rlike(t.NUMERIC_KINDS)
    return rows.filter(number).select("eval", "metric", F.try_variant_get("x", "$", "double").alias("value"))
