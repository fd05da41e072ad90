"""Table functions for SQL: files of packages as rows, joined laterally to a table of files.

    SELECT f.path, v.* FROM files f, LATERAL xml_values(f.content) v

Each takes one binary column and checks it when the query is analysed. A file that can't be read
gives one row with its error, a null one no row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from voltlake.functions import formats

ERRORS = (SyntaxError, ValueError, LookupError, TypeError)  # a parse error is a SyntaxError


def _table_function(name: str, columns: str, rows):
    """A table function with the columns and an error, whose rows come from a file's bytes."""
    schema = StructType.fromDDL(f"{columns}, error string")
    width = len(schema.fields) - 1

    class Rows:
        @staticmethod
        def analyze(content: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(content.dataType, BinaryType):
                raise ValueError(f"{name} takes the bytes of a file")
            return AnalyzeResult(schema)

        def eval(self, content) -> Iterator[tuple]:
            if content is None:
                return
            try:
                found = list(rows(bytes(content)))
            except ERRORS as e:
                yield (*[None] * width, str(e) or type(e).__name__)
                return
            for row in found:
                yield (*row, None)

    Rows.__name__ = name
    return udtf(Rows)


def _sensors(raw: bytes):
    return [(s["number"], s["type"], s["name"], s["x"], s["y"], s["z"]) for s in formats.layout_sensors(raw)]


def _steps(raw: bytes):
    from voltlake.plans.script import VOCABULARY

    return [(k, step["op"], {name: str(v) for name, v in step["parameters"].items()}) for k, step in enumerate(formats.read_script(raw, VOCABULARY))]


#: Name, columns, rows of a file.
FUNCTIONS = {
    "xml_values": ("path string, value string", lambda raw: formats.flattened(raw).items()),
    "layout_sensors": ("number int, type int, name string, x double, y double, z double", _sensors),
    "script_steps": ("seq int, op string, parameters map<string,string>", _steps),
}


def register_tables(spark: SparkSession) -> list[str]:
    for name, (columns, rows) in FUNCTIONS.items():
        spark.udtf.register(name, _table_function(name, columns, rows))
    return list(FUNCTIONS)
