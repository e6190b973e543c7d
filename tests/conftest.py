from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from depgraph import schemas
from depgraph.session import tune
from depgraph.sources import feeds as E


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("depgraph-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


def declaration(name, kind="def", module="Root.A", line=1, **more):
    row = {
        "name": name, "shortName": name.rsplit(".", 1)[-1], "kind": kind, "namespace": "",
        "sourceFile": "f", "startLine": line, "endLine": line + 1, "sourceText": "s", "docstring": None,
        "attrs": [], "isProtected": False, "isExternal": False, "isDeprecated": False, "deprecatedSince": None,
    }
    return {**row, **more}


def module(name, imports=(), declarations=(), **more):
    row = {
        "module": name, "path": name + ".src", "docstring": None, "title": None, "tags": [], "authors": [],
        "isDeprecated": False, "namespaces": [],
        "imports": [{"name": target, "isPublic": False, "isDeprecated": False} for target in imports],
        "declarations": list(declarations),
    }
    return {**row, **more}


def record(name, seq, deps=(), **more):
    row = {
        "seq": seq, "name": name, "typeSignature": f"sig {name}", "extends": [], "instantiates": None,
        "instancePriority": None, "deprecatedBy": None, "additiveVersion": None, "fields": [],
        "constructors": [], "module": "Root.A",
        "deps": [{"name": dep, "inType": False, "inValue": True} for dep in deps],
    }
    return {**row, **more}


@pytest.fixture
def make_feeds(spark):
    def build(modules=(), records=()):
        return E.flatten(
            spark.createDataFrame(list(modules), schemas.MODULE_FEED),
            spark.createDataFrame(list(records), schemas.EXTRACT_FEED),
        )

    return build


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in picked.collect()), key=lambda r: tuple(map(str, r)))
