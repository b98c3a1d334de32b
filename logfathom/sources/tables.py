"""Log lines and events derived from an ``events`` table of user actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scale import compute_once, spread

# How each kind of action reads as a log line.
LEVEL_OF = {"error": "ERROR", "signup": "WARN", "click": "DEBUG"}
MESSAGE_OF = {"signup": "Door code rejected", "purchase": "Basket paid",
              "view": "Shelf opened"}


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the columns the operators expect; `event_id` is the arrival position."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    refused = (kind == "error") & (F.col("event_id") % 2 == 0)
    level: Column = F.lit("INFO")
    for name, value in LEVEL_OF.items():
        level = F.when(kind == name, value).otherwise(level)
    head = F.when(refused, "Ledger write refused").when(kind == "error", "Thumbnail job gave up")
    for name, value in MESSAGE_OF.items():
        head = head.when(kind == name, value)
    key = (F.when(refused, "waited").when(kind == "error", "asset").when(kind == "click", "tile")
            .when(kind == "signup", "door").when(kind == "purchase", "cents").otherwise("shopper"))
    user = F.col("user_id").cast("string")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    value = (F.when(refused | (kind == "purchase"), cents)
              .when(kind == "error", F.concat(F.lit("asset_"), user))
              .when(kind == "click", F.concat(F.lit("tile_page_"), user))
              .when(kind == "signup", F.concat(F.lit("10.7.0."),
                                               (F.col("user_id") % 255).cast("string")))
              .otherwise(user))
    return table.select(
        F.concat(F.lit("svc-"), (F.col("user_id") % 3).cast("string")).alias("source"),
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        level.alias("level"), head.otherwise("Tile served").alias("head"),
        key.alias("key"), value.alias("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, seq, ts, level, message), as a stored event table would hold them."""
    return load_events(spark, sf_dir).select(
        "source", "seq", "ts", "level",
        F.concat("head", F.lit(" | "), "key", F.lit("="), "value").alias("message"))


LAYOUTS = ("logfmt", "bracket", "json", "simple", "container")


def raw_lines(spark: SparkSession, sf_dir: str, layout: str = "logfmt") -> DataFrame:
    """(source, line, seq, ingest_ts): every event rendered as a log line.

    `layout` is one of LAYOUTS, or ``mixed``: then the five layouts take turns and the
    number of the layout is part of the source name, so that each source has one format.
    """
    rows = spread(load_events(spark, sf_dir))
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss.SSSSSS")
    iso = F.concat(day, F.lit("T"), clock, F.lit("Z"))
    spaced = F.concat(day, F.lit(" "), clock)
    low = F.lower("level")
    pair = F.concat("key", F.lit("="), "value")
    text = F.concat("head", F.lit(" | "), pair)

    def join(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    rendered = {
        "logfmt": join('time="', iso, '" level=', low, ' msg="', F.col("head"), '" ', pair),
        "bracket": join(spaced, " [", F.col("level"), "] ", text),
        "json": join('{"time":"', iso, '","level":"', low, '","msg":"', F.col("head"), '","',
                     F.col("key"), '":"', F.col("value"), '"}'),
        "simple": join(spaced, " ", F.col("level"), " ", text),
        "container": join('{"log":"time=\\"', iso, '\\" level=', low, ' msg=\\"', F.col("head"),
                          '\\" ', pair, '\\n","stream":"stdout","time":"', iso, '"}'),
    }
    if layout == "mixed":
        turn = F.col("seq") % len(LAYOUTS)
        source = join(F.col("source"), "-", turn.cast("string"))
        line = F.lit(None).cast("string")
        for number, name in enumerate(LAYOUTS):
            line = F.when(turn == number, rendered[name]).otherwise(line)
    else:
        source, line = F.col("source"), rendered[layout]
    lines = compute_once(rows, source=source, line=line)
    return lines.select("source", "line", "seq", F.lit(None).cast("timestamp").alias("ingest_ts"))
