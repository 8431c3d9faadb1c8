"""Text logs of a bus: comma-separated lines and free text with labelled fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hex_to_int(text: Column) -> Column:
    """Hex digits (with or without 0x) to INT; anything else becomes null."""
    digits = F.regexp_replace(F.trim(text), "^0[xX]", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(digits, 16, 10).try_cast("bigint").try_cast("int"))


def _label(text: Column) -> Column:
    """T (injected) or 1 is an attack frame, R (regular) or 0 is not."""
    up = F.upper(F.trim(text))
    return F.when(up.isin("T", "1"), 1).when(up.isin("R", "0"), 0)


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Compute columns in one generator row, so that the filters on them do not repeat the parsing."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _split_good(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every column of ``parsed`` decides about validity, so none is computed in vain."""
    ok = (
        F.col("t").isNotNull()
        & F.col("can_id").isNotNull()
        & F.col("dlc").between(0, 8)
        & F.col("flag").isNotNull()
        & (F.size("payload") == F.col("dlc"))
        & ~F.exists("payload", lambda b: b.isNull() | (b > 255))
    )
    marked = parsed.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    good = marked.where("_ok").select(
        "line_id", "t", F.round(F.col("t") * 1e6).cast("bigint").alias("t_us"), "can_id", "dlc", "payload", "flag"
    )
    corrupt = marked.where("NOT _ok").select("line_id", F.col("line").alias("_corrupt"))
    return good, corrupt


def parse_can_csv(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``line`` = t,hex id,dlc,bytes…,label → (frames, corrupt lines).

    The number of byte fields follows the dlc field and the label is the last token, so short frames parse too.
    """
    tokens = F.split("line", ",")
    n = F.size("_tok")
    dlc = F.get("_tok", F.lit(2)).try_cast("int")
    body = F.slice("_tok", F.lit(4), F.greatest(F.lit(0), n - 4))
    parsed = _once(
        _once(lines, ["line_id", "line"], _tok=tokens),
        ["line_id", "line"],
        t=F.get("_tok", F.lit(0)).try_cast("double"),
        can_id=hex_to_int(F.get("_tok", F.lit(1))),
        dlc=dlc,
        payload=F.transform(body, hex_to_int),
        flag=_label(F.get("_tok", n - 1)),
    )
    return _split_good(parsed)


def parse_can_txt(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``line`` such as ``Timestamp: 1.5 ID: 0316 DLC: 2 a0 ff Flag: R`` → (frames, corrupt lines)."""
    body = F.regexp_extract("line", r"DLC:\s*\d+((?:\s+[0-9A-Fa-f]{2})*)(?=\s|$)", 1)
    parsed = _once(
        lines,
        ["line_id", "line"],
        t=F.regexp_extract("line", r"Timestamp:\s*([0-9.eE+-]+)", 1).try_cast("double"),
        can_id=hex_to_int(F.regexp_extract("line", r"ID:\s*([0-9A-Fa-fxX]+)", 1)),
        dlc=F.regexp_extract("line", r"DLC:\s*(\d+)", 1).try_cast("int"),
        payload=F.transform(F.regexp_extract_all(body, F.lit("([0-9A-Fa-f]{2})"), F.lit(1)), hex_to_int),
        flag=_label(F.regexp_extract("line", r"Flag:\s*(\w)", 1)),
    )
    return _split_good(parsed)


def read_can_log(spark: SparkSession, path: str, style: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Read a text log from files. The line id is only unique per read, not dense."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))
    return (parse_can_csv if style == "csv" else parse_can_txt)(lines)


def csv_lines(frames: DataFrame) -> DataFrame:
    """Frames as comma-separated log lines, with only as many byte fields as the dlc says."""
    hexes = F.transform("payload", lambda b: F.lower(F.lpad(F.hex(b), 2, "0")))
    return frames.select(
        F.col("seq").alias("line_id"),
        F.array_join(
            F.concat(
                F.array(_seconds_text(), F.lower(F.lpad(F.hex("can_id"), 4, "0")), F.col("dlc").cast("string")),
                hexes,
                F.array(F.when(F.col("flag") == 1, "T").otherwise("R")),
            ),
            ",",
        ).alias("line"),
    )


def txt_lines(frames: DataFrame) -> DataFrame:
    """Frames as labelled free text."""
    hexes = F.array_join(F.transform("payload", lambda b: F.concat(F.lit(" "), F.lower(F.lpad(F.hex(b), 2, "0")))), "")
    return frames.select(
        F.col("seq").alias("line_id"),
        F.concat(
            F.lit("Timestamp: "), _seconds_text(), F.lit(" ID: "), F.lower(F.lpad(F.hex("can_id"), 4, "0")),
            F.lit(" DLC: "), F.col("dlc").cast("string"), hexes,
            F.lit(" Flag: "), F.when(F.col("flag") == 1, "T").otherwise("R"),
        ).alias("line"),
    )


def _seconds_text() -> Column:
    return F.format_string("%d.%06d", F.floor(F.col("t_us") / 1_000_000), F.pmod(F.col("t_us"), F.lit(1_000_000)))
