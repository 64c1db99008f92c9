"""Error codes, their categories and exit codes (P33 rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Category -> exit code.
EXITS = {
    "SUCCESS": 0, "VERIFICATION_FAILED": 1, "USAGE": 2, "INVALID_INPUT": 3, "AUTHENTICATION_FAILED": 4, "INSUFFICIENT_REDUNDANCY": 5,
    "UNSUPPORTED_FORMAT": 6, "CONFIGURATION_ERROR": 7, "OUTPUT_ERROR": 8, "PROVIDER_ERROR": 10, "INTERNAL_ERROR": 70,
}
#: Category -> stable codes. Only insufficient redundancy is worth another try (with more reads).
CODES = {
    "UNSUPPORTED_FORMAT": ["CONTAINER_VERSION_UNSUPPORTED", "FEATURE_UNSUPPORTED", "LEGACY_FORMAT", "FRAME_VERSION_UNSUPPORTED", "SUPERBLOCK_VERSION_UNSUPPORTED", "SCHEMA_UNSUPPORTED"],
    "INVALID_INPUT": ["FORMAT_ERROR", "LAYOUT_UNDETECTED", "ARCHIVE_TAG_AMBIGUOUS", "ARCHIVE_TAG_NOT_FOUND", "MULTIPLE_ARCHIVES", "ADDRESS_ERROR", "RESOURCE_LIMIT"],
    "INSUFFICIENT_REDUNDANCY": ["NO_SUPERBLOCK", "INSUFFICIENT_REDUNDANCY", "BUDGET_EXCEEDED"],
    "VERIFICATION_FAILED": ["CONTAINER_HASH_MISMATCH", "INTEGRITY_ERROR", "ARCHIVE_MISMATCH"],
    "AUTHENTICATION_FAILED": ["WRONG_KEY", "KEY_FOR_UNENCRYPTED"],
    "CONFIGURATION_ERROR": ["CONSTRAINT_ERROR", "CONFIGURATION_ERROR", "VENDOR_MAX_LENGTH", "ARCHIVE_TAG_COLLISION"],
    "OUTPUT_ERROR": ["OUTPUT_ERROR"],
    "PROVIDER_ERROR": ["PROVIDER_ERROR"],
    "INTERNAL_ERROR": ["INTERNAL_ERROR"],
}
RETRYABLE = {"INSUFFICIENT_REDUNDANCY"}


def rows() -> list[tuple[str, str, int, bool]]:
    """(code, category, exit code, retryable) of every code."""
    return [(code, category, EXITS[category], category in RETRYABLE) for category, codes in CODES.items() for code in codes]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "code string, category string, exit_code int, retryable boolean")


def explained(reports: DataFrame, code: str) -> DataFrame:
    """``reports`` with category, exit_code, retryable; an unknown code is an internal error, none is a success.

    The dimension has as many rows as there are codes, so it is broadcast.
    """
    known = reports.join(F.broadcast(table(reports.sparkSession).withColumnRenamed("code", code)), code, "left")
    none = F.col(code).isNull()
    return known.withColumns({
        "category": F.when(none, "SUCCESS").otherwise(F.coalesce("category", F.lit("INTERNAL_ERROR"))),
        "exit_code": F.when(none, EXITS["SUCCESS"]).otherwise(F.coalesce("exit_code", F.lit(EXITS["INTERNAL_ERROR"]))),
        "retryable": F.coalesce("retryable", F.lit(False)),
    })
