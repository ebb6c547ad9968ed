"""Readers with explicit schemas, so that no file is scanned to find its types."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINKAGE = "id_1 int, id_2 int, cmp_fname_c1 double, cmp_fname_c2 double, cmp_lname_c1 double, cmp_lname_c2 double, cmp_sex int, cmp_bd int, cmp_bm int, cmp_by int, cmp_plz int, is_match boolean"
#: Columns of the forest cover table in order (fixed values): numbers, one-hot groups, class.
COVER_NUMBERS = [
    "Elevation", "Aspect", "Slope", "Horizontal_Distance_To_Hydrology", "Vertical_Distance_To_Hydrology",
    "Horizontal_Distance_To_Roadways", "Hillshade_9am", "Hillshade_Noon", "Hillshade_3pm", "Horizontal_Distance_To_Fire_Points",
]
COVER_GROUPS = {"wilderness": [f"Wilderness_Area_{i}" for i in range(4)], "soil": [f"Soil_Type_{i}" for i in range(40)]}
COVER_LABEL = "Cover_Type"
#: Columns of a table of network connections in order (fixed values).
CONNECTION_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent", "hot",
    "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count", "srv_count",
    "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate",
    "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate",
    "dst_host_srv_rerror_rate", "label",
]
_CONNECTION_TEXTS = {"protocol_type", "service", "flag", "label"}


def preview(spark: SparkSession, path: str) -> DataFrame:
    """A CSV without header as text columns _c0, _c1, ..."""
    return spark.read.csv(path)


def linkage(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """Compared pairs: a CSV with header in which ? is a missing value."""
    reader = spark.read.option("header", True).option("nullValue", "?")
    return reader.option("inferSchema", True).csv(path) if infer else reader.schema(LINKAGE).csv(path)


def forest_cover(spark: SparkSession, path: str) -> DataFrame:
    """A CSV without header: ten numbers, 4 + 40 columns of 0 and 1, the class as a double."""
    names = [*COVER_NUMBERS, *(c for group in COVER_GROUPS.values() for c in group)]
    return spark.read.schema(T.StructType([*(T.StructField(n, T.IntegerType()) for n in names), T.StructField(COVER_LABEL, T.DoubleType())])).csv(path)


def connections(spark: SparkSession, path: str) -> DataFrame:
    """A CSV without header: 42 columns, four of them text."""
    return spark.read.schema(T.StructType([T.StructField(n, T.StringType() if n in _CONNECTION_TEXTS else T.DoubleType()) for n in CONNECTION_COLUMNS])).csv(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files."""
    return spark.read.text(path)


def play_counts(spark: SparkSession, path: str) -> DataFrame:
    """(user, artist, count) of lines of three integers; others are dropped (see ``rejects``)."""
    return _integers(lines(spark, path), ["user", "artist", "count"], " ").dropna()


def artists(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of lines ``id TAB name``; lines without a tab, an integer or a name are dropped."""
    row = lines(spark, path).where(F.instr("value", "\t") > 0)
    parts = row.select(F.substring_index("value", "\t", 1).try_cast("int").alias("id"), F.trim(F.expr("substr(value, instr(value, '\t') + 1)")).alias("name"))
    return parts.where("id is not null and name != ''")


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(artist, alias) of lines of two integers with a tab between; others are dropped."""
    return _integers(lines(spark, path), ["artist", "alias"], "\t").dropna()


def _integers(raw: DataFrame, names: list[str], separator: str) -> DataFrame:
    parts = F.split("value", separator)
    whole = raw.where(F.size(parts) == len(names))
    return whole.select(*(F.get(parts, F.lit(i)).try_cast("int").alias(n) for i, n in enumerate(names)))


def rejects(spark: SparkSession, path: str, fields: int, separator: str) -> DataFrame:
    """(value): lines that aren't ``fields`` integers."""
    parts = F.split("value", separator)
    good = (F.size(parts) == fields) & F.forall(parts, lambda p: p.try_cast("int").isNotNull())
    return lines(spark, path).where(~good)


def trips_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all columns text; ``operators.trips.parse_trips`` makes rides of it."""
    return spark.read.option("header", True).csv(path)


def tagged_records(spark: SparkSession, path: str, tag: str, partitions: int | None = None) -> DataFrame:
    """(record): the text from each ``<tag ...>`` to its ``</tag>``, which isn't kept whole in memory with others.

    Files are split at the end tag, so records may be of any length in lines; text outside records is dropped.
    """
    raw = spark.read.option("lineSep", f"</{tag}>").text(path)
    begin = rf"(?s)^.*?(<{tag}[\s>].*)$"
    found = raw.where(F.col("value").rlike(rf"<{tag}[\s>]")).select(F.concat(F.regexp_extract("value", begin, 1), F.lit(f"</{tag}>")).alias("record"))
    return found.repartition(partitions) if partitions else found


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, contents) of the ``<page>`` records of an XML dump, with or without an element around them all.

    Records are cut at their end tags, so a large file has many tasks; those that are no XML come with nulls.
    """
    fields = "title string, revision struct<text: struct<_VALUE: string>>"
    pages = tagged_records(spark, path, "page").select(F.from_xml("record", F.lit(fields)).alias("page"))
    return pages.select("page.title", F.col("page.revision.text._VALUE").alias("contents"))


def citations(spark: SparkSession, path: str) -> DataFrame:
    """(record): the XML of each citation."""
    return tagged_records(spark, path, "MedlineCitation")


def price_histories(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, date, close): one CSV per symbol, named by it, with a header, the date first and the close fifth.

    Rows that can't be read are dropped.  Two-digit years are those of this century.
    """
    raw = spark.read.option("header", True).schema("day string, open string, high string, low string, close string, volume string").csv(path)
    symbol = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = raw.select(F.url_decode(symbol).alias("symbol"), F.coalesce(F.try_to_timestamp("day", F.lit("d-MMM-yy")), F.try_to_timestamp("day", F.lit("yyyy-MM-dd"))).cast("date").alias("date"), F.col("close").try_cast("double").alias("close"))
    return rows.dropna()


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, id, properties map of text, geometry as text) of a feature collection; ids are places in the file."""
    schema = "features array<struct<id: string, properties: map<string, string>, geometry: string>>"
    found = spark.read.option("multiLine", True).schema(schema).json(path).select(F.posexplode("features"))
    return found.select(F.col("pos").cast("long").alias("feature_id"), "col.id", "col.properties", "col.geometry")


def stop_words(spark: SparkSession | str, path: str | None = None) -> list[str]:
    """One word a line, of a file in any place the session can read, or of a local file if only its path is given."""
    if path is None:
        with open(spark, encoding="utf-8") as words:
            return [w.strip() for w in words if w.strip()]
    return [r["w"] for r in lines(spark, path).select(F.btrim("value").alias("w")).where("w != ''").collect()]


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(contig, feature_type, start, end, strand, attributes) of a GTF file; starts are counted from 0."""
    schema = "contig string, source string, feature_type string, first long, end long, score string, strand string, frame string, attributes string"
    raw = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(schema).csv(path)
    return raw.select("contig", "feature_type", (F.col("first") - 1).alias("start"), "end", "strand", "attributes")


def narrow_peaks(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end, name, score) of a narrowPeak or BED file."""
    schema = "contig string, start long, end long, name string, score double, strand string, signal double, p double, q double, peak long"
    return spark.read.option("sep", "\t").option("comment", "#").schema(schema).csv(path).select("contig", "start", "end", "name", "score")


def variants(spark: SparkSession, path: str) -> DataFrame:
    """(contig, position, id, ref, alt, quality, filter, info) of a VCF file; positions are counted from 1."""
    schema = "contig string, position long, id string, ref string, alt string, quality string, filter string, info string"
    return spark.read.option("sep", "\t").option("comment", "#").schema(schema).csv(path)


def two_bit(spark: SparkSession, path: str) -> DataFrame:
    """(contig, seq) of 2bit files: four bases a byte, blocks of N put back; soft masks are ignored. One file is one task."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for name, sequence in _two_bit_sequences(bytes(content)):
                    yield pd.DataFrame({"contig": [name], "seq": [sequence]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "contig string, seq string")


def _two_bit_sequences(content: bytes) -> Iterator[tuple[str, str]]:
    order = "<" if content[:4] == b"\x43\x27\x41\x1a" else ">"
    number = np.dtype(f"{order}u4")

    def read(at: int, n: int = 1) -> np.ndarray:
        return np.frombuffer(content, number, n, at)

    at, index = 16, []
    for _ in range(int(read(8)[0])):
        length = content[at]
        name = content[at + 1 : at + 1 + length].decode()
        index.append((name, int(read(at + 1 + length)[0])))
        at += 5 + length
    letters = np.frombuffer(b"TCAG", np.uint8)
    for name, at in index:
        size, blocks = int(read(at)[0]), int(read(at + 4)[0])
        starts, sizes = read(at + 8, blocks), read(at + 8 + 4 * blocks, blocks)
        at += 8 + 8 * blocks
        at += 4 + 8 * int(read(at)[0]) + 4
        packed = np.frombuffer(content, np.uint8, -(-size // 4), at)
        bases = letters[np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel()[:size]]
        for start, length in zip(starts, sizes, strict=True):
            bases[int(start) : int(start) + int(length)] = ord("N")
        yield name, bases.tobytes().decode()


def image_stack(spark: SparkSession, path: str, shape: tuple[int, int, int], dtype: str = "float16", order: str = "F") -> DataFrame:
    """(t, x, y, z, value) of flat binary frames of one shape; t is the number in the file's name. One frame is one row to start with."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, content in zip(batch["t"], batch["content"], strict=True):
                frame = np.frombuffer(bytes(content), dtype).reshape(shape, order=order)
                x, y, z = (a.ravel() for a in np.indices(shape))
                yield pd.DataFrame({"t": np.full(frame.size, t), "x": x, "y": y, "z": z, "value": frame.ravel().astype(float)})

    files = spark.read.format("binaryFile").load(path)
    numbered = files.select(F.regexp_extract("path", r"(\d+)[^\d/]*$", 1).try_cast("int").alias("t"), "content")
    return numbered.mapInPandas(decode, "t int, x int, y int, z int, value double")


def tiff_stack(spark: SparkSession, path: str) -> DataFrame:
    """(t, x, y, z, value) of TIFF files; t is the number in the file's name, z the page. One file is one row to start with.

    Grey pages in strips, of whole numbers or floats of 8 to 64 bits, plain or deflated; others are an error.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, content in zip(batch["t"], batch["content"], strict=True):
                for z, page in enumerate(_tiff_pages(bytes(content))):
                    y, x = (a.ravel() for a in np.indices(page.shape))
                    yield pd.DataFrame({"t": np.full(page.size, t), "x": x, "y": y, "z": np.full(page.size, z), "value": page.ravel().astype(float)})

    files = spark.read.format("binaryFile").load(path)
    numbered = files.select(F.regexp_extract("path", r"(\d+)[^\d/]*$", 1).try_cast("int").alias("t"), "content")
    return numbered.mapInPandas(decode, "t int, x int, y int, z int, value double")


#: Tags of a page and the sizes of field types, as the format names them (fixed values).
_WIDTH, _HEIGHT, _BITS, _PACKING, _OFFSETS, _SAMPLES, _LENGTHS, _DIFFERENCES, _FORMAT = 256, 257, 258, 259, 273, 277, 279, 317, 339
_FIELDS = {1: "u1", 3: "u2", 4: "u4"}


def _tiff_pages(content: bytes) -> Iterator[np.ndarray]:
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if not order or np.frombuffer(content, f"{order}u2", 1, 2)[0] != 42:
        raise ValueError("no TIFF file")
    at, seen = int(np.frombuffer(content, f"{order}u4", 1, 4)[0]), set()
    while at and at not in seen:
        seen.add(at)
        count = int(np.frombuffer(content, f"{order}u2", 1, at)[0])
        tags: dict[int, list[int]] = {}
        for entry in range(at + 2, at + 2 + 12 * count, 12):
            tag, kind = (int(v) for v in np.frombuffer(content, f"{order}u2", 2, entry))
            if kind in _FIELDS:
                n, field = int(np.frombuffer(content, f"{order}u4", 1, entry + 4)[0]), np.dtype(order + _FIELDS[kind])
                place = entry + 8 if n * field.itemsize <= 4 else int(np.frombuffer(content, f"{order}u4", 1, entry + 8)[0])
                tags[tag] = np.frombuffer(content, field, n, place).tolist()
        packing = tags.get(_PACKING, [1])[0]
        if tags.get(_SAMPLES, [1])[0] != 1 or packing not in (1, 8, 32946) or tags.get(_DIFFERENCES, [1])[0] != 1:
            raise ValueError("a TIFF page of a form that isn't read")
        strips = [content[start : start + length] for start, length in zip(tags[_OFFSETS], tags[_LENGTHS], strict=True)]
        pixels = b"".join(strips if packing == 1 else map(zlib.decompress, strips))
        dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(_FORMAT, [1])[0]] }{tags[_BITS][0] // 8}")
        yield np.frombuffer(pixels, dtype, tags[_WIDTH][0] * tags[_HEIGHT][0]).reshape(tags[_HEIGHT][0], tags[_WIDTH][0])
        at = int(np.frombuffer(content, f"{order}u4", 1, at + 2 + 12 * count)[0])


def numbers(spark: SparkSession, start: int, count: int, tasks: int | None = None) -> DataFrame:
    """(id): consecutive integers."""
    return spark.range(start, start + count, 1, tasks)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A table as Parquet, in folders by the columns ``by`` if given; what is there is replaced."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def feature_collection(features: DataFrame) -> DataFrame:
    """(json): each feature (id, properties map, geometry text) as a GeoJSON feature, one a row."""
    quoted = F.to_json(F.array("id"))  # in brackets, which are cut off
    named = F.when(F.col("id").isNotNull(), F.concat(F.lit(',"id":'), F.substr(quoted, F.lit(2), F.length(quoted) - 2)))
    head = F.concat(F.lit('{"type":"Feature"'), F.coalesce(named, F.lit("")))
    return features.select(F.concat(head, F.lit(',"properties":'), F.coalesce(F.to_json("properties"), F.lit("{}")), F.lit(',"geometry":'), F.coalesce("geometry", F.lit("null")), F.lit("}")).alias("json"))
