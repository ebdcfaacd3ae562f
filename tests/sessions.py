"""The local session that tests and the check tool share."""

from __future__ import annotations

from tidemark.session import build_session


def local_session():
    spark = build_session(
        "tidemark-tests", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.sql.codegen.cache.maxEntries": "2000",
        })
    spark.sparkContext.setLogLevel("ERROR")
    return spark
