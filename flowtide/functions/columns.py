"""Column expressions for cleaning, labelling and per-row features.

Everything here stays inside whole-stage code generation: no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that mark a flow label as malicious.
MALICIOUS_KEYWORDS = (
    "botnet",
    "attack",
    "anomaly",
    "malicious",
    "ddos",
    "worm",
    "spam",
    "blacklist",
)

# Timestamp layout of the headered flow files, well-known port range,
# guard against division by zero, steepness of the anomaly sigmoid.
CTU_TIME_FORMAT = "yyyy/MM/dd HH:mm:ss.SSSSSS"
WELL_KNOWN_PORT_LIMIT = 1024
EPSILON = 1e-9
SIGMOID_STEEPNESS = 5.0


def q(name: str) -> Column:
    """Column by exact name, also when the name holds dots or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def no_nan(column: Column) -> Column:
    """NaN means missing in the input files, so it becomes NULL."""
    return F.when(F.isnan(column), F.lit(None)).otherwise(column)


def parse_timestamp(column: Column, fmt: str | None = None) -> Column:
    """Text to timestamp without zone; anything unreadable becomes NULL."""
    parsed = F.try_to_timestamp(column, F.lit(fmt)) if fmt else F.try_to_timestamp(column)
    return parsed.cast("timestamp_ntz")


def epoch_to_timestamp(column: Column) -> Column:
    """Epoch seconds to timestamp without zone."""
    return F.timestamp_seconds(column).cast("timestamp_ntz")


def micros(column: Column) -> Column:
    """Microseconds since the epoch, for plain and zoned timestamps alike."""
    return F.unix_micros(column.cast("timestamp"))


def parse_port(column: Column, on_error: str = "zero") -> Column:
    """Decimal or 0x-prefixed port text to INT; unreadable text to 0 or NULL."""
    if on_error not in ("zero", "null"):
        raise ValueError("on_error must be 'zero' or 'null'")
    text = column.cast("string")
    digits = F.trim(text)
    # Only the lower-case prefix counts, and every digit is checked first because
    # conv() silently stops at the first character it cannot read.
    port = (
        F.when(text.rlike("^0x[0-9a-fA-F]+$"), F.conv(F.substring(text, 3, 64), 16, 10).try_cast("int"))
        .when(digits.rlike("^[+-]?[0-9]+$"), digits.try_cast("int"))
        .otherwise(F.lit(None).cast("int"))
    )
    return F.coalesce(port, F.lit(0)) if on_error == "zero" else port


def to_double(column: Column) -> Column:
    return no_nan(column.try_cast("double"))


def to_bigint(column: Column) -> Column:
    """Whole numbers, also when written as '12.0'."""
    return F.coalesce(column.try_cast("bigint"), to_double(column).try_cast("bigint"))


def fill_tos(column: Column) -> Column:
    return F.coalesce(to_double(column), F.lit(0.0)).cast("int")


def contains_word(column: Column, word: str = "Botnet") -> Column:
    """1 when the text holds the word in any case; NULL text counts as 0."""
    return F.coalesce(F.contains(F.lower(column), F.lit(word.lower())), F.lit(False)).cast("int")


def contains_any(column: Column, words: Sequence[str] = MALICIOUS_KEYWORDS) -> Column:
    """1 when the text holds any of the words in any case; NULL text counts as 0."""
    return F.coalesce(column.rlike("(?i)" + "|".join(words)), F.lit(False)).cast("int")


def extract_scenario(column: Column) -> Column:
    """First capital V followed by two digits, else 'Unknown'."""
    found = F.regexp_extract(F.coalesce(column, F.lit("")), r"(V\d{2})", 1)
    return F.when(found == "", F.lit("Unknown")).otherwise(found)


def hour_of_day(column: Column) -> Column:
    return F.hour(column)


def day_of_week(column: Column) -> Column:
    """Monday is 0."""
    return F.weekday(column)


def epoch_seconds(column: Column) -> Column:
    return F.unix_seconds(column.cast("timestamp"))


def bytes_per_packet(total_bytes: Column, packets: Column) -> Column:
    return F.try_divide(total_bytes, packets + 1)


def bytes_ratio(src_bytes: Column, total_bytes: Column) -> Column:
    return F.try_divide(src_bytes, total_bytes + 1)


def total_packets(fwd: Column, bwd: Column) -> Column:
    return F.coalesce(fwd, F.lit(0)) + F.coalesce(bwd, F.lit(0))


def fwd_packet_ratio(fwd: Column, total: Column) -> Column:
    return F.try_divide(fwd, total + 1)


def log_feature(column: Column, null_as_zero: bool = False) -> Column:
    return F.log1p(F.coalesce(column, F.lit(0)) if null_as_zero else column)


def is_common_port(column: Column) -> Column:
    return F.coalesce((column > 0) & (column < WELL_KNOWN_PORT_LIMIT), F.lit(False)).cast("int")


def short_label(column: Column) -> Column:
    """Label text cut to plot width after shortening its two long prefixes."""
    text = F.replace(F.replace(column, F.lit("Background-"), F.lit("BG-")), F.lit("Botnet-"), F.lit("Bot-"))
    return F.substring(text, 1, 35)


def label_severity(column: Column) -> Column:
    text = F.lower(column)
    return (
        F.when(text.contains("bot") | text.contains("attack"), "malicious")
        .when(text.contains("blacklist") | text.contains("anomaly"), "suspicious")
        .otherwise("background")
    )


def regularity_score(cv: Column) -> Column:
    """Inverse coefficient of variation: large for machine-like regularity."""
    return F.lit(1.0) / (cv + EPSILON)


def variation(std: Column, mean: Column) -> Column:
    """std / mean with the guard of the fitted statistics; missing and infinite become 0."""
    cv = F.try_divide(std, mean + EPSILON)
    return F.when(cv.isNull() | F.isnan(cv) | (F.abs(cv) == float("inf")), F.lit(0.0)).otherwise(cv)


def anomaly_flag(error: Column, threshold: Column) -> Column:
    return (error > threshold).cast("int")


def anomaly_probability(error: Column, threshold: Column) -> Column:
    """Sigmoid of the error's distance from the threshold, in units of the threshold."""
    unit = F.when(threshold > 0, threshold).otherwise(1.0)
    return 1 / (1 + F.exp(-(error - threshold) / unit * SIGMOID_STEEPNESS))
