"""Readers for detections, labels, ground truth, manifests, reports and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxweave import schemas
from boxweave.functions import scalars as S
from boxweave.session import broadcast_if_small


def read_detections(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = schemas.DETECTIONS) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_head_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HEAD_CELLS).parquet(path)


def label_files_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, lines) from rows with ``path`` and text ``content``; an empty file keeps its row."""
    lines = F.filter(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n"), lambda x: F.trim(x) != "")
    stems = files.select(S.stem_of(F.col("path")).alias("image_stem"), F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n").alias("all"), lines.alias("lines"))
    counted = stems.select("image_stem", F.size("lines").alias("n_lines"))
    numbered = stems.select("image_stem", F.posexplode("all").alias("pos", "line")).where(F.trim("line") != "")
    return counted, numbered.select("image_stem", (F.col("pos") + 1).alias("line_no"), "line")


def read_label_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Label text files of a folder.

    DataFrame file sources skip empty files, which are negatives here, so the whole-file
    reader is used; it lists them too and reads them on the executors.
    """
    sc = spark.sparkContext
    texts = sc.wholeTextFiles(f"{folder.rstrip('/')}/*.txt", max(sc.defaultParallelism, 2))
    return label_files_of(spark.createDataFrame(texts, "path string, content string"))


def read_gt_map(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth JSON: image name to boxes."""
    text = spark.read.text(path, wholetext=True)
    images = text.select(F.explode(F.from_json("value", schemas.GT_MAP)).alias("image", "boxes"))
    boxes = images.select("image", F.posexplode("boxes").alias("gt_ord", "b"))
    corners = [F.col("b.box")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return boxes.select("image", "gt_ord", "b.class_id", "b.label", *corners)


def read_coco(spark: SparkSession, path: str, subset: DataFrame, categories: dict[int, tuple[int, str]]) -> tuple[DataFrame, DataFrame]:
    """(boxes, images) of a COCO file for the images in ``subset`` (``image_path``) and the given categories.

    Image ids are the numbers in the file names. Category ids map to class id and label.
    """
    doc = spark.read.schema(schemas.COCO).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.width", "i.height")
    notes = doc.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id", "a.bbox")
    wanted = subset.where(F.trim("image_path") != "").select(F.substring_index(F.trim("image_path"), "/", -1).alias("image"))
    wanted = broadcast_if_small(wanted.withColumn("image_id", F.substring_index("image", ".", 1).cast("long")).distinct())
    known = F.create_map(*[F.lit(x) for k, (i, _) in categories.items() for x in (k, i)])
    names = F.create_map(*[F.lit(x) for k, (_, n) in categories.items() for x in (k, n)])
    kept = notes.where(F.col("category_id").isin(list(categories))).join(wanted, "image_id")
    b = F.col("bbox")
    boxes = kept.select(
        "image", known[F.col("category_id")].alias("class_id"), names[F.col("category_id")].alias("label"),
        b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2"),
    )
    return boxes, images.join(wanted, "image_id")


def read_manifest(spark: SparkSession, path: str, schema: str, required: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """CSV manifest. The header must have the required columns; malformed rows are errors.

    Columns of the schema that the file lacks come as null. Quotes within a value are doubled.
    ``multi_line``: values may hold line breaks (a file is then read by one task).
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    header = reader.csv(path).columns
    missing = sorted(set(required or []) - set(header))
    if missing:
        raise ValueError(f"manifest lacks columns: {', '.join(missing)}")
    empty = spark.createDataFrame([], schema)
    types = {f.name: f.dataType.simpleString() for f in empty.schema.fields}
    read_as = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
    df = reader.option("mode", "FAILFAST").schema(read_as).csv(path)
    return df.select(*[F.col(c) if c in header else F.lit(None).cast(t).alias(c) for c, t in types.items()])


def check_reports(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parsed report messages; broken JSON has a null ``report`` and ``valid`` false.

    ``thumbnail_ok`` is null without a picture.
    """
    parsed = lines.withColumn("report", F.from_json(column, f"{schemas.REPORT}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("report._corrupt_record").isNotNull() | F.col("report").isNull()
    t = F.col("report.thumbnail")
    ok = F.when(t["data"].isNotNull() & (t["data"] != ""), S.payload_matches(t["width"], t["height"], t["data"]))
    return parsed.select(
        *lines.columns, (~broken).alias("valid"), F.when(~broken, F.col("report").dropFields("_corrupt_record")).alias("report"), ok.alias("thumbnail_ok")
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return check_reports(spark.read.text(path))


def inventory_of(files: DataFrame) -> DataFrame:
    """Name, session, class folder, size and content hash from rows with ``path`` and ``content``."""
    name = F.substring_index("path", "/", -1)
    folder = F.element_at(F.split("path", "/"), -2)
    return files.select(
        "path", name.alias("image_name"), S.session_of(name).alias("session"), folder.alias("folder"),
        F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"),
    )


def image_inventory(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png,bmp,webp}") -> DataFrame:
    """Pictures below a folder; contents are hashed where they are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return inventory_of(raw.select("path", "content"))


def stream_detections(spark: SparkSession, path: str | None = None, kafka: dict | None = None, schema: str = schemas.DETECTIONS,
                      max_files: int | None = None, glob: str | None = None) -> DataFrame:
    """Detection stream from a folder of parquet files or from Kafka (JSON values)."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("d")).select("d.*")
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)
