"""Session settings that suit rule evaluation."""

from __future__ import annotations

import warnings

from pyspark.sql import SparkSession

# HotSpot does not compile methods of more than 8000 bytes of bytecode, and many
# conditions fused into one generated method pass that size easily.  With this
# limit Spark then generates each operator on its own, in small methods.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
}


# From about this many tests on the setting makes a clear difference.
MANY_TESTS = 25


def advise(spark: SparkSession, tests: int) -> None:
    """Warn where many tests meet a session that was not tuned."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if tests >= MANY_TESTS and int(spark.conf.get(key, "65535")) > int(SETTINGS[key]):
        warnings.warn(f"{tests} tests run several times faster after ruleloom.session.tune(spark)", stacklevel=4)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
