"""A function applied to each page, the responses it gives, and the rows of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.names import output_url

RESPONSE = (
    "candidates array<struct<content:struct<parts:array<struct<text:string,"
    "inline_data:struct<mime_type:string,data:string>,file_data:struct<file_uri:string>>>>>>"
)
# Texts of failed results.
NO_IMAGE = "no image produced"
FAILED = "翻譯失敗: "


def apply_pages(
    df: DataFrame, make_function: Callable[[], Callable[[dict], object]], input_columns: list[str], output: str = "body", concurrency: int | None = None
) -> DataFrame:
    """``df`` with the function's text (column ``output``), status and error.

    ``make_function`` runs once in each task and gives the function that is called
    with a dict of ``input_columns`` for each row.  An exception makes its row
    ``failed`` with the exception's text, never the task.  All other columns go through
    as they are.  ``concurrency`` sets the number of tasks, for which the rows, with all
    their columns, are dealt anew.  The function may be slow and paid for: write the result once and
    go on from there; a second action would call it again.
    """
    if concurrency:
        df = df.repartition(concurrency)
    added = [output, "status", "error"]
    kept = [i for i, f in enumerate(df.schema) if f.name not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make_function()
        for batch in batches:
            bodies, errors = [], []
            for row in batch.select(input_columns).to_pylist():
                try:
                    body = function(row)
                    bodies.append(None if body is None else str(body))
                    errors.append(None)
                except Exception as e:
                    bodies.append(None)
                    errors.append(str(e) or type(e).__name__)
            status = ["success" if e is None else "failed" for e in errors]
            new = [pa.array(x, pa.string()) for x in (bodies, status, errors)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *new], [*(batch.schema.names[i] for i in kept), *added])

    schema = StructType([*(df.schema.fields[i] for i in kept), *(StructField(name, StringType()) for name in added)])
    return df.mapInArrow(run, schema)


def parse_responses(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with payload (binary), success and text.

    The first part of the first candidate that holds inline data gives the payload;
    links to files are ignored; no candidate, no part, text alone or text that is not
    JSON is a failure.  text is that of all text parts, joined.
    """
    parts = F.get(F.from_json(F.col(body), RESPONSE)["candidates"], 0)["content"]["parts"]
    image = F.get(F.filter(parts, lambda p: F.coalesce(p["inline_data"]["data"] != "", F.lit(False))), 0)
    payload = F.unbase64(image["inline_data"]["data"])
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull())
    return df.withColumns({"payload": payload, "success": payload.isNotNull(), "text": F.array_join(texts, "")})


def result_struct(success: Column, url: Column, failure: Column) -> dict[str, Column]:
    error = F.when(failure.isNotNull(), F.concat(F.lit(FAILED), failure)).when(~success, F.lit(NO_IMAGE))
    ok = success & failure.isNull()
    return {"success": ok, "output_url": F.when(ok, url), "error": error, "code": F.when(failure.isNotNull(), 500).otherwise(200)}


def to_results(df: DataFrame, failure: str | None = None) -> DataFrame:
    """``df`` (success, output_name[, failure text]) with success, output_url, error and code."""
    why = F.col(failure) if failure else F.lit(None).cast("string")
    return df.withColumns(result_struct(F.coalesce("success", F.lit(False)), output_url(F.col("output_name")), why))
