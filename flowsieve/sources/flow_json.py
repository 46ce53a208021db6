"""Flow records sent as JSON: one object or a list of objects per payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.network import protocol_name
from flowsieve.functions.text import (
    clean_text_from_json,
    float_from_json,
    int_from_json,
    strict_int_from_json,
    text_from_json,
    time_from_json,
    variant_values,
)
from flowsieve.schema import EXTRA, EXTRA_FLOAT_FIELDS, EXTRA_INT_FIELDS, EXTRA_TEXT_FIELDS


_CORE = ("ts", "src_ip", "dst_ip", "proto", "bytes")
_INTS = (*EXTRA_INT_FIELDS, "ssl_version")
_FLOATS = EXTRA_FLOAT_FIELDS
_WORDS = (*EXTRA_TEXT_FIELDS, "service")
_RECORDS = "array<struct<" + ", ".join(f"{n}: variant" for n in (*_CORE, *_INTS, *_FLOATS, *_WORDS)) + ">>"


def payload_records(payloads: DataFrame, column: str = "value", unusable: bool = False) -> DataFrame:
    """One struct `rec` of VARIANT fields per flow object; an object counts as a list of one.

    Payloads of another shape give no rows, or with `unusable` one row without `pos` and `rec`. `pos` is
    the place of the record inside its payload; other columns are kept.
    """
    rest = [c for c in payloads.columns if c != column]
    if not unusable:
        each = payloads.select(*rest, F.posexplode(F.from_json(F.col(column), _RECORDS)).alias("pos", "rec"))
        return each.where(F.col("rec").isNotNull())
    read = payloads.select(*rest, F.from_json(F.col(column), _RECORDS).alias("_records"))
    each = read.select(*rest, F.col("_records").isNull().alias("_other"), F.posexplode_outer("_records").alias("pos", "rec"))
    return each.where(F.col("_other") | F.col("rec").isNotNull()).drop("_other")


def rejected_payloads(payloads: DataFrame, column: str = "value") -> DataFrame:
    return payloads.where(F.from_json(F.col(column), _RECORDS).isNull())


def parsed_flows(records: DataFrame, ingest_time: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flow columns of `rec`, with `rejected` naming what makes a record unusable (null if fine).

    Known attribute keys are coerced, others dropped; the struct is null when nothing is left.
    """
    rest = list(keep)
    values = lambda names: variant_values([F.col(f"rec.{n}") for n in names])
    arrays = F.struct(
        values(_CORE).alias("core"),
        F.transform(values(_INTS), int_from_json).alias("ints"),
        F.transform(values(_FLOATS), float_from_json).alias("floats"),
        F.transform(values(_WORDS), clean_text_from_json).alias("words"),
    )
    # Unpacked by a generator, which filters on the result are not pushed through:
    # otherwise the coercions would run once more for every filter.
    typed = records.select(*rest, F.inline(F.array(arrays)))
    ts, src, dst, proto, size = (F.get("core", F.lit(i)) for i in range(len(_CORE)))
    # A missing address is empty; an explicit null cannot be stored.
    address = lambda v: F.when(v["kind"] == "absent", F.lit("")).otherwise(text_from_json(v))
    attributes: dict[str, Column] = {}
    for group, names in (("ints", _INTS), ("floats", _FLOATS), ("words", _WORDS)):
        for i, n in enumerate(names):
            attributes[n] = F.get(group, F.lit(i))
    attributes["service"] = F.lower(attributes["service"])
    flat = typed.select(
        *rest,
        time_from_json(ts, ingest_time).alias("timestamp"),
        address(src).alias("src_ip"),
        address(dst).alias("dst_ip"),
        protocol_name(text_from_json(proto)).alias("proto"),
        strict_int_from_json(size).alias("bytes"),
        *[c.alias(f"x_{n}") for n, c in attributes.items()],
    )
    fields = [
        (F.col(f"x_{f.name}") if f.name in attributes else F.lit(None)).cast(f.dataType).alias(f.name) for f in EXTRA.fields
    ]
    filled = F.coalesce(*[F.col(f"x_{n}").cast("string") for n in attributes]).isNotNull()
    problem = (
        F.when(F.col("src_ip").isNull(), F.lit("src_ip"))
        .when(F.col("dst_ip").isNull(), F.lit("dst_ip"))
        .when(F.col("bytes").isNull(), F.lit("bytes"))
    )
    return flat.select(
        *rest,
        "timestamp",
        "src_ip",
        "dst_ip",
        "proto",
        "bytes",
        F.when(filled, F.struct(*fields)).alias("extra"),
        problem.alias("rejected"),
    )


def usable(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("rejected").isNull()).drop("rejected")


def rejected(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("rejected").isNotNull())


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payload files, one payload per file, with the file name kept."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def read_payload_lines(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited payloads, with the file name kept."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
