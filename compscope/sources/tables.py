"""CSV and parquet libraries in and out."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.libraries import tag_libraries, union_by_name
from ..session import materialise

# Text encodings to try after UTF-8, in this order.
ENCODINGS = (
    "utf_8", "ascii", "big5", "big5hkscs", "cp037", "cp273", "cp424", "cp437", "cp500", "cp720",
    "cp737", "cp775", "cp850", "cp852", "cp855", "cp856", "cp857", "cp858", "cp860", "cp861",
    "cp862", "cp863", "cp864", "cp865", "cp866", "cp869", "cp874", "cp875", "cp932", "cp949",
    "cp950", "cp1006", "cp1026", "cp1125", "cp1140", "cp1250", "cp1251", "cp1252", "cp1253",
    "cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "euc_jp", "euc_jis_2004", "euc_jisx0213",
    "euc_kr", "gb2312", "gbk", "gb18030", "hz", "iso2022_jp", "iso2022_jp_1", "iso2022_jp_2",
    "iso2022_jp_2004", "iso2022_jp_3", "iso2022_jp_ext", "iso2022_kr", "latin_1", "iso8859_2",
    "iso8859_3", "iso8859_4", "iso8859_5", "iso8859_6", "iso8859_7", "iso8859_8", "iso8859_9",
    "iso8859_10", "iso8859_11", "iso8859_13", "iso8859_14", "iso8859_15", "iso8859_16", "johab",
    "koi8_r", "koi8_t", "koi8_u", "kz1048", "mac_cyrillic", "mac_greek", "mac_iceland",
    "mac_latin2", "mac_roman", "mac_turkish", "ptcp154", "shift_jis", "shift_jis_2004",
    "shift_jisx0213", "utf_32", "utf_32_be", "utf_32_le", "utf_16", "utf_16_be", "utf_16_le",
    "utf_7", "utf_8_sig",
)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV with a header line. Give a ``schema`` for large data: inferring it reads twice."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_csv_checked(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str
) -> tuple[DataFrame, DataFrame]:
    """CSV with a header line: the rows that fit ``schema``, and the others as they stand in the
    file (``_corrupt_record``) instead of nulls that nobody sees."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = (
        spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(T.StructType([*wanted.fields, T.StructField("_corrupt_record", T.StringType())]))
        .csv(path)
    )
    # A projection on the corrupt record alone would not parse the line.
    bad = F.col("_corrupt_record").isNotNull()
    return rows.where(~bad).select(wanted.fieldNames()), rows.where(bad)


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_libraries(
    spark: SparkSession,
    paths: Sequence[str],
    structure_columns: Sequence[str],
    labels: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
    row_id: str = "row_id",
) -> tuple[DataFrame, DataFrame]:
    """Several library files as one table with ``Structure``, ``Dataset`` and ``row_id`` columns,
    and the table of display labels (``LIB-i`` unless given).

    Ids are unique over all libraries and follow the order of the lines. They are made once, at
    ingest, and written with the rows, so a later read or a retried task sees the same ones.
    """
    frames = []
    names = [f"LIB-{i}" for i in range(1, len(paths) + 1)]
    for name, path, column in zip(names, paths, structure_columns, strict=True):
        df = read_csv(spark, path, schema)
        line = F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0")
        frames.append(
            df.withColumn("Structure", F.col(column).cast("string"))
            .withColumn(row_id, F.concat_ws("-", F.lit(name), line))
        )
    legend = spark.createDataFrame(
        list(zip(names, labels or names, strict=True)), "Dataset string, display_label string"
    )
    return materialise(tag_libraries(frames), "libraries"), legend


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


# Byte order marks, the longer ones first.
MARKS = (("fffe0000", "utf_32_le"), ("0000feff", "utf_32_be"), ("fffe", "utf_16_le"), ("feff", "utf_16_be"))
WIDE = {"utf_16_le": "UTF-16LE", "utf_16_be": "UTF-16BE", "utf_32_le": "UTF-32LE", "utf_32_be": "UTF-32BE"}


def _raw_lines(spark: SparkSession, path: str | Sequence[str], wide: str | None = None) -> DataFrame:
    """Undecoded lines with their file, and whether a line is the file's first; large files are
    split over tasks. ``wide`` names an encoding whose characters take several bytes, line ends
    included."""
    reader = spark.read.option("lineSep", "\n").option("encoding", WIDE[wide]) if wide else spark.read
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw"),
        F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"),
    )
    starts = lines.where("_at = 0").groupBy("file").agg(F.min("_n").alias("_first"))
    return lines.join(starts, "file").select("file", "raw", (F.col("_n") == F.col("_first")).alias("first"))


def wide_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, encoding`` of the UTF-16 and UTF-32 files: by their byte order mark, else by where
    the zero bytes of the first line stand."""
    head = F.hex(F.substring("raw", 1, 64))
    found = F.lit(None).cast("string")
    # Three marks for each zero byte: a third of the bytes for two-byte characters, over 60 % for four.
    zeros = F.length(F.regexp_replace(F.regexp_replace(head, "(..)", "$1-"), "(?!00-)..-", ""))
    wide, quad = zeros * 2 > F.length(head), zeros * 10 > F.length(head) * 9
    for test, little, big in ((wide, "utf_16_le", "utf_16_be"), (wide & quad, "utf_32_le", "utf_32_be")):
        # Most characters of a header are small numbers: the zero bytes lead in big-endian files.
        found = F.when(test, F.when(F.substring(head, 1, 2) == "00", big).otherwise(little)).otherwise(found)
    for mark, name in reversed(MARKS):
        found = F.when(F.startswith(F.lower(head), F.lit(mark)), name).otherwise(found)
    return (
        _raw_lines(spark, path).where("first").select("file", found.alias("encoding"))
        .where("encoding IS NOT NULL")
    )


def detect_encodings(
    spark: SparkSession,
    path: str | Sequence[str],
    encodings: Sequence[str] = ENCODINGS,
    header_has: str | None = None,
) -> DataFrame:
    """``file, encoding`` for every file: the first encoding that decodes all its lines, null if
    none does.

    Files with wide characters are known by their first bytes, UTF-8 ones by a test inside the
    JVM; only lines of the other files go to Python. With ``header_has`` (say, the structure
    column's name) the first line must also contain that text once decoded, which rules out
    single-byte encodings that accept anything. Every task tests its own lines and emits one row
    per batch; a file is decided by a small aggregate.
    """
    narrow = [e for e in encodings if not e.startswith(("utf_16", "utf_32"))]
    wide = wide_files(spark, path).where(F.col("encoding").isin(list(encodings)))
    lines = _raw_lines(spark, path)
    has = F.lit(True) if header_has is None else F.contains("raw", F.lit(header_has).cast("binary"))
    utf8 = lines.groupBy("file").agg(
        (F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))) & F.bool_or(F.col("first") & has)).alias("utf8")
    )
    easy = F.when(F.col("utf8") & F.lit("utf_8" in narrow), "utf_8")
    known = utf8.join(wide, "file", "left").select("file", F.coalesce("encoding", easy).alias("known"))
    known = materialise(known, "encodings")

    def test(batches):
        for batch in batches:
            for file, rows in batch.groupby("file"):
                ok, seen = [], []
                for enc in narrow:
                    try:
                        text = [bytes(r).decode(enc) for r in rows["raw"]]
                        ok.append(True)
                        seen.append(header_has is None or any(
                            header_has in t for t, f in zip(text, rows["first"]) if f))
                    except (UnicodeError, LookupError):
                        ok.append(False)
                        seen.append(False)
                yield type(batch)({"file": [file] * len(ok), "rank": range(len(ok)),
                                   "ok": ok, "seen": seen})

    hard = lines.join(known.where("known IS NULL").select("file"), "file", "left_semi")
    tested = hard.select("file", "raw", "first").mapInPandas(
        test, "file string, rank int, ok boolean, seen boolean"
    )
    names = F.array(*[F.lit(e) for e in narrow])
    decided = (
        tested.groupBy("file", "rank")
        .agg(F.bool_and("ok").alias("ok"), F.bool_or("seen").alias("seen"))
        .where("ok AND seen")
        .groupBy("file")
        .agg(F.min("rank").alias("rank"))
        .select("file", F.element_at(names, F.col("rank") + 1).alias("_found"))
    )
    return known.join(decided, "file", "left").select(
        "file", F.coalesce("known", "_found").alias("encoding")
    )


def read_csv_any_encoding(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str,
    encodings: Sequence[str] = ENCODINGS,
    header_has: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """CSV files of mixed encodings: the rows, and the files (``file``) that no encoding decodes.

    Each file is decoded with the encoding detected for it. Its first line is the header: columns
    are found by name, without regard to case and order, so files may differ in layout; a later
    line that looks like the header is data. Rows that do not parse carry their text in
    ``_corrupt_record``. A record is one line; only its line end and a byte order mark at the start
    of the file are taken off.
    """
    found = materialise(detect_encodings(spark, path, encodings, header_has), "encodings")
    rejects = found.where("encoding IS NULL").select("file")

    def decode(batches):
        for batch in batches:
            text = [bytes(r).decode(e) for r, e in zip(batch["raw"], batch["encoding"])]
            yield type(batch)({
                "file": batch["file"], "first": batch["first"],
                "line": [t.removeprefix("\ufeff") if f else t for t, f in zip(text, batch["first"])],
            })

    wide_names = [r[0] for r in found.select("encoding").distinct().collect() if r[0] in WIDE]
    parts = []
    for name in [None, *wide_names]:  # at most one read per width and byte order
        mine = found.where("encoding IS NOT NULL")
        mine = mine.where(F.col("encoding") == name) if name else mine.where(~F.col("encoding").isin(list(WIDE)))
        parts.append(_raw_lines(spark, path, name).join(mine, "file"))
    lines = union_by_name(parts).mapInPandas(decode, "file string, first boolean, line string")
    lines = materialise(lines.withColumn("line", F.regexp_replace("line", "\\r$", "")), "lines")
    layout = lines.where("first").select("file", F.trim("line").alias("layout"))
    data = lines.where("NOT first AND line != ''").join(layout, "file")
    wanted = T.StructType.fromDDL(schema)
    out = None
    for (header,) in layout.select("layout").distinct().collect():  # one row per layout of the files
        cells = next(csv.reader([header]), [])
        kinds = {f.name.lower(): f for f in wanted.fields}
        fields = [
            T.StructField(kinds[c.strip().lower()].name, kinds[c.strip().lower()].dataType)
            if c.strip().lower() in kinds else T.StructField(f"_other{i}", T.StringType())
            for i, c in enumerate(cells)
        ]
        own = T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())])
        parsed = F.from_csv(
            "line", own.simpleString()[len("struct<"):-1].replace(":", " "),
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
        )
        there = {f.name for f in fields}
        rows = data.where(F.col("layout") == header).select(parsed.alias("r")).select(
            *[F.col(f"r.{f.name}") if f.name in there else F.lit(None).cast(f.dataType).alias(f.name)
              for f in wanted.fields],
            "r._corrupt_record",
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], T.StructType([*wanted.fields, T.StructField("_corrupt_record", T.StringType())]))
    return out, rejects
