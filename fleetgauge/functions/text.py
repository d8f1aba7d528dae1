"""Numbers out of tool logs and probe documents; each log is one row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetgauge.functions import rules as R

PACKET = T.StructType([T.StructField(n, T.StringType()) for n in ("pts", "dts", "flags")])
PACKETS = T.StructType([T.StructField("packets", T.ArrayType(PACKET))])
# Log patterns.
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
METRIC_PATTERNS = {"psnr": r"\baverage:(inf|[0-9]+(?:\.[0-9]+)?)", "ssim": r"\bAll:([0-9]+(?:\.[0-9]+)?)"}
THROUGHPUT_PATTERNS = {
    "throughput_qps": rf"(?s)Throughput:\s*{NUMBER}\s*qps",
    "latency_median_ms": rf"(?s)Latency:.*?median\s*=\s*{NUMBER}\s*ms",
    "latency_p95_ms": rf"(?s)Latency:.*?percentile\(95%\)\s*=\s*{NUMBER}\s*ms",
    "gpu_compute_median_ms": rf"(?s)GPU Compute Time:.*?median\s*=\s*{NUMBER}\s*ms",
    "gpu_compute_p95_ms": rf"(?s)GPU Compute Time:.*?percentile\(95%\)\s*=\s*{NUMBER}\s*ms",
}
LEVEL_PATTERN = r"(mean|max)_volume:\s+(-?(?:inf|\d+(?:\.\d+)?)) dB"
LINE_BREAK = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"


def explode_packets(df: DataFrame, json_column: str) -> DataFrame:
    """One row per packet of a probe document, with its position in the list."""
    packets = F.from_json(json_column, PACKETS)["packets"]
    rest = [n for n in df.columns if n != json_column]
    return df.select(*rest, F.posexplode(packets).alias("index", "_p")).select(*rest, "index", "_p.*")


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def parse_metric_log(text: Column, metric: str) -> Column:
    """struct(found, exact, value) of the last summary in a quality log; ``inf`` is exact, null."""
    value = last_match(text, METRIC_PATTERNS[metric])
    return F.struct(
        value.isNotNull().alias("found"),
        F.when(value.isNotNull(), value == "inf").alias("exact"),
        F.when(value != "inf", value.cast("double")).alias("value"),
    )


def parse_throughput_log(df: DataFrame, text: str) -> DataFrame:
    """Five named numbers of a throughput log and an error per missing one."""
    found = {
        name: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double")
        for name, pattern in THROUGHPUT_PATTERNS.items()
    }
    return df.withColumns({**found, "errors": R.labels([(f"no {n}", v.isNull()) for n, v in found.items()])})


def parse_level_log(df: DataFrame, text: str, minimum_mean: float) -> DataFrame:
    """Last mean and peak level in decibels; both must be there and the mean not too low."""
    level = lambda name: F.replace(
        last_match(F.col(text), LEVEL_PATTERN.replace("mean|max", name).replace("(" + name + ")", name)), F.lit("inf"), F.lit("Infinity")
    ).cast("double")
    mean, peak = level("mean"), level("max")
    return df.withColumns({
        "mean_dbfs": mean, "peak_dbfs": peak,
        "errors": R.labels([
            ("levels are missing", mean.isNull() | peak.isNull()),
            (f"mean level is below {minimum_mean:g}", mean < minimum_mean),
        ]),
    })


def parse_prefixed_pairs(df: DataFrame, text: str, prefix: str, names: Sequence[str]) -> DataFrame:
    """``<prefix><name>=<number>`` lines as one column per name; the last line of a name counts.

    One expression takes the prefixed lines out of the log.  They and the texts of the names are
    columns of their own, so that no name reads the log again, and are folded inside the row, so
    no explode and no pivot shuffle are needed.
    """
    taken, helpers = {n.lower() for n in [*df.columns, *names, "errors"]}, []
    for helper in ("_lines", *[f"_text_{i}" for i in range(len(names))]):
        while helper.lower() in taken:
            helper = f"_{helper}"
        taken.add(helper.lower())
        helpers.append(helper)
    found, texts = helpers[0], dict(zip(names, map(F.col, helpers[1:])))
    # The literal comes first, which the engine looks for without trying every character.
    fixed, breaks = re.escape(prefix), LINE_BREAK.split("|")[1]
    pattern = f"{fixed}(?<=(?:^|{breaks}){fixed})[^{breaks[1:]}*"
    lines = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda l: l.contains("="))
    key = lambda l: F.substring_index(F.substr(l, F.lit(len(prefix) + 1)), "=", 1)
    raw = lambda l: F.regexp_extract(l, "(?s)^[^=]*=(.*)$", 1)

    def last_of(name: str) -> Column:
        return F.try_element_at(F.transform(F.filter(found, lambda l: key(l) == F.lit(name)), raw), F.lit(-1))

    values = {n: texts[n].try_cast("double") for n in names}
    bad = F.lit(False)
    for n in names:
        bad = bad | (texts[n].isNotNull() & values[n].isNull())
    missing = F.array_join(R.labels([(n, texts[n].isNull()) for n in sorted(names)]), ", ")
    folded = df.withColumn(found, lines).withColumns({h: last_of(n) for h, n in zip(helpers[1:], names)})
    return folded.withColumns({
        **values,
        "errors": R.labels([("invalid value", bad), (F.concat(F.lit("missing fields: "), missing), missing != "")]),
    }).drop(*helpers)


def filled_lines(text: Column) -> Column:
    """Number of lines that hold something besides white space."""
    return F.size(F.filter(F.split(text, LINE_BREAK), lambda l: l.rlike(r"(?U)\S")))


def line_count_errors(lines: Column, expected: Column) -> Column:
    return R.labels([("compared frames differ from expected frames", R.differs(lines.cast("long"), expected.cast("long")))])
