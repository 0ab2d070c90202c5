"""Driver tables read as the schemas the operators expect.

Every fixture uses whole tables; arithmetic on ids only makes values, it never picks rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import uniform
from ..operators.ordering import shared_folder, widen
from ..sources.files import arrow_system


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.lit(values), index.cast("int"))


def listing(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ext = _pick(["png", "jpg", "webp", "bmp", "txt"], F.col("doc_id") % 5)
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), ext)
    columns = [
        F.col("doc_id"),
        F.concat_ws("/", "source", "lang", name).alias("rel_path"),
        F.col("source").alias("category"),
        name.alias("name"),
        F.concat(F.lit("."), ext).alias("ext"),
        F.col("n_chars").alias("bytes"),
        (64 + F.col("n_chars") % 700).cast("int").alias("w"),
        (64 + F.col("doc_id") % 700).cast("int").alias("h"),
    ]
    return docs.select(*columns, *(["text"] if text else []))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, size``: a path for each document below a folder to be made, with hidden, ``_`` and ``=`` parts."""
    n = F.col("doc_id")
    folder = F.when(n % 13 == 0, F.lit(None)).otherwise(F.concat(F.when(n % 4 == 0, F.lit("_")).otherwise(F.lit("")), F.col("category")))
    lang = F.element_at(F.split("rel_path", "/"), 2)
    inner = F.when(n % 17 == 0, F.lit(".git")).when(n % 3 == 0, F.concat(F.lit("lang="), lang)).when(n % 3 == 1, F.lit("deep/_tmp/x"))
    name = F.concat(F.when(n % 7 == 0, F.lit("_")).when(n % 11 == 0, F.lit(".h_")).otherwise(F.lit("")), F.col("name"))
    return listing(spark, sf_dir).select(F.concat_ws("/", folder, F.when(folder.isNotNull(), inner), name).alias("file"), (F.col("bytes") % 5).alias("size"))


def write_tree(df: DataFrame, root: str) -> None:
    """Make the files of :func:`tree` below ``root``, in tasks."""

    def make(frames):
        system, base = arrow_system(root)
        for frame in frames:
            for file, size in zip(frame["file"], frame["size"]):
                system.create_dir(f"{base}/{file}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{base}/{file}") as out:
                    out.write(b"x" * size)
            yield frame[["size"]]

    widen(df).mapInPandas(make, "size bigint").agg(F.count("size")).collect()


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = widen(table(spark, sf_dir, "events"))
    n = F.col("event_id")
    box = e.select(
        F.col("user_id").alias("img"),
        n.alias("det_idx"),
        (n * 37 % 400).cast("double").alias("x1"),
        (n * 53 % 300).cast("double").alias("y1"),
        (40 + n % 80).cast("double").alias("bw"),
        (40 + n * 7 % 80).cast("double").alias("bh"),
        uniform("event_id", "s", 7).alias("score"),
        (n % 3).cast("int").alias("cls"),
        (300 + F.col("user_id") % 200).cast("int").alias("img_w"),
        (240 + F.col("user_id") % 160).cast("int").alias("img_h"),
    )
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x1, y1, bw, bh = (F.col(c) for c in ("x1", "y1", "bw", "bh"))
    marks = F.array(
        point(x1 + 10, y1 + 12),
        point(x1 + 10 + F.col("det_idx") % 12, y1 + 12 + F.col("det_idx") % 5),
        point(x1 + bw / 2, y1 + bh / 2),
        point(x1 + bw / 4, y1 + bh * 0.75),
        point(x1 + bw * 0.75, y1 + bh * 0.75),
    )
    return box.withColumns({"x2": x1 + bw, "y2": y1 + bh, "lm": marks}).drop("bw", "bh")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return (
        table(spark, sf_dir, "events")
        .select(u.alias("img"), (300 + u % 200).cast("int").alias("w"), (240 + u % 160).cast("int").alias("h"))
        .distinct()
    )


def _pixel(e: Column) -> Column:
    return F.round(F.least(F.greatest((e.cast("double") + 1) * 127.5, F.lit(0.0)), F.lit(255.0)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 planes: ``vec_id, label, h, w, plane``."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", _pixel).alias("plane")
    )


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three consecutive vectors are the channels of an image."""
    v = vectors(spark, sf_dir)
    return v.select(F.floor(F.col("vec_id") / 3).alias("img"), (F.col("vec_id") % 3).cast("int").alias("ch"), "h", "w", "plane")


def plane_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector 2k against vector 2k+1."""
    v = vectors(spark, sf_dir).withColumn("pair", F.floor(F.col("vec_id") / 2))
    side = lambda k: F.max(F.when(F.col("vec_id") % 2 == k, F.col("plane")))
    both = v.groupBy("pair", "h", "w").agg(side(0).alias("a"), side(1).alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").select("pair", F.lit(0).alias("ch"), "h", "w", "a", "b")


def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image 2k against image 2k+1, one row per channel both have."""
    p = planes(spark, sf_dir).withColumn("pair", F.floor(F.col("img") / 2))
    side = lambda k: F.max(F.when(F.col("img") % 2 == k, F.col("plane")))
    both = p.groupBy("pair", "ch", "h", "w").agg(side(0).alias("a"), side(1).alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL")


def enlarge(column: str, factor: int = 3, side: int = 8) -> Column:
    """Repeat every pixel ``factor`` times in both directions."""
    big = side * factor
    return F.transform(
        F.sequence(F.lit(0), F.lit(big * big - 1)),
        lambda p: F.get(F.col(column), (F.floor(p / (big * factor)) * side + F.floor((p % big) / factor)).cast("int")),
    )


def large_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 24 x 24 planes of the same image numbering as :func:`planes`."""
    cell = lambda p: F.get("embedding", (F.floor(p / 72) * 8 + F.floor((p % 24) / 3)).cast("int"))
    return widen(table(spark, sf_dir, "embeddings")).select(
        F.floor(F.col("vec_id") / 3).alias("img"), (F.col("vec_id") % 3).cast("int").alias("ch"), F.lit(24).alias("h"), F.lit(24).alias("w"),
        F.transform(F.sequence(F.lit(0), F.lit(575)), lambda p: _pixel(cell(p))).alias("plane"),
    )


def large_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane pairs enlarged to 24 x 24."""
    return plane_pairs(spark, sf_dir).select("pair", "ch", F.lit(24).alias("h"), F.lit(24).alias("w"), enlarge("a").alias("a"), enlarge("b").alias("b"))


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = e.groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("m"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("s"))
    return packed.select(F.col("label").cast("bigint").alias("code_id"), F.transform("s", lambda s: s["m"]).alias("vec"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss series: ``run, iteration, rank, value, ts``."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("run"),
        F.col("event_id").alias("iteration"),
        F.col("event_type"),
        (F.col("value") / 1000).alias("value"),
        "ts",
    )


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, one file or a folder of files, as a file stream."""
    schema = table(spark, sf_dir, name).schema
    # A pattern, since a plain path must be a folder for the stream.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}"


def log_lines(events: DataFrame) -> DataFrame:
    """Training log text built from events; error events give lines without losses."""
    e = events.select("event_id", "event_type", "value", (F.col("event_id") * 77 % 200000).alias("s"))
    days = F.floor(F.col("s") / 86400)
    day_text = F.when(days == 0, F.lit("")).when(days == 1, F.lit("1 day, ")).otherwise(F.format_string("%d days, ", days))
    clock = F.format_string(
        "%d:%02d:%02d", F.floor(F.col("s") % 86400 / 3600), F.floor(F.col("s") % 3600 / 60), F.col("s") % 60
    )
    loss = F.col("value") / 1000
    good = F.format_string(
        "[train..][epoch:%3d, iter:%,8d, lr:(5.000e-05,)] [eta: %s, time (data): %.3f (0.010)] "
        "l_g_pix: %.4e l_g_percep: %.4e l_g_identity: %.4e ",
        F.floor(F.col("event_id") / 1000), F.col("event_id"), F.concat(day_text, clock), F.lit(52.25), loss, loss * 3, loss * 2,
    )
    other = F.format_string("Saving models and training states of %d.", F.col("event_id"))
    return e.select("event_id", F.when(F.col("event_type") == "error", other).otherwise(good).alias("value"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run, path, bytes, mtime`` with model, state, latest and unparsable names."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    run = F.concat(F.lit("run_"), (F.col("o_custkey") % 10).cast("string"))
    name = (
        F.when(key % 97 == 0, F.lit("models/net_g_latest.pth"))
        .when(key % 89 == 0, F.lit("models/net_g_final.pth"))
        .when(key % 2 == 0, F.concat(F.lit("models/net_g_"), key.cast("string"), F.lit(".pth")))
        .otherwise(F.concat(F.lit("training_states/"), key.cast("string"), F.lit(".state")))
    )
    return o.select(
        run.alias("run"), F.concat_ws("/", run, name).alias("path"), F.floor("o_totalprice").cast("bigint").alias("bytes"), F.col("o_orderdate").alias("mtime"), "o_orderkey"
    )


def progress_events(events: DataFrame) -> DataFrame:
    """Progress events: the event type names the stage, purchases complete a request."""
    stage = F.when(F.col("event_type") == "purchase", "complete").otherwise(F.col("event_type"))
    return events.select(
        F.col("user_id").alias("request"), stage.alias("stage"), (F.col("event_id") % 100 / 100).alias("progress"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), "ts", "event_id",
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifest rows, some broken in a known way; a reference only for labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has"))
    j = docs.join(labelled, "doc_id", "left")
    n, num = F.col("doc_id"), F.col("doc_id").cast("string")
    return j.select(
        F.when(n % 50 == 7, F.when(n % 250 == 7, F.lit("  ")).otherwise(F.concat(F.lit("dup_"), (n % 3).cast("string")))).otherwise(F.concat(F.lit(" doc_"), num)).alias("id"),
        F.when(n % 60 == 11, F.lit("")).when(n % 70 == 13, F.concat(F.lit("inputs/"), num, F.lit(".gif"))).otherwise(F.concat(F.lit("inputs/"), num, F.lit(".jpg"))).alias("input_path"),
        F.when(F.col("has"), F.when(n % 40 == 0, F.concat(F.lit("/refs/"), num, F.lit(".tiff"))).otherwise(F.concat(F.lit("references/"), num, F.lit(".PNG")))).otherwise(F.lit("")).alias("reference_path"),
        F.when(n % 80 == 3, F.lit(" ")).otherwise(F.col("source")).alias("category"),
        F.lit("fixture").alias("notes"),
    )
