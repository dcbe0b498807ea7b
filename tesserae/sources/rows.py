"""Row-documents: rows of any table, or of CSV text, rendered as lines of `name: value`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.errors import ParseError


def row_text(columns: list[str]) -> Column:
    """`name: value` of every column with a value that isn't empty, a line each."""
    value = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat_ws("\n", *[F.when(v != "", F.concat(F.lit(f"{c}: "), v)) for c, v in zip(columns, value)])


def row_documents(df: DataFrame, id_column: str, prefix: str = "row", text_columns: list[str] | None = None) -> DataFrame:
    """(uri, text, meta): text of the chosen columns, all columns as meta. Null and empty values have no line."""
    pairs = [x for c in df.columns for x in (F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))]
    return df.select(F.concat(F.lit(f"{prefix}#"), F.col(id_column).cast("string")).alias("uri"), row_text(text_columns or df.columns).alias("text"), F.create_map(*pairs).alias("meta"))


def parse_csv(text: str, delimiter: str = ",", header: bool = True) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """Column names and numbered records. A quote anywhere opens or closes quoting and a doubled one inside stands for
    itself; carriage returns outside quotes go; blank lines are passed over but counted; a record of another width is an error."""
    records: list[tuple[int, list[str]]] = []
    field, fields, quoted, number, k = [], [], False, 1, 0

    def end() -> None:
        nonlocal number
        fields.append("".join(field))
        field.clear()
        if fields != [""]:
            records.append((number, fields.copy()))
        fields.clear()
        number += 1

    while k < len(text):
        c = text[k]
        if c == '"':
            if quoted and text[k + 1 : k + 2] == '"':
                field.append(c)
                k += 1
            else:
                quoted = not quoted
        elif quoted:
            field.append(c)
        elif c == delimiter:
            fields.append("".join(field))
            field.clear()
        elif c == "\n":
            end()
        elif c != "\r":
            field.append(c)
        k += 1
    if quoted:
        raise ParseError("a quoted field doesn't end")
    if field or fields:
        end()
    if not records:
        return [], []
    names = [x.strip(" \t") for x in records.pop(0)[1]] if header else [f"col{i + 1}" for i in range(len(records[0][1]))]
    for n, r in records:
        if len(r) != len(names):
            raise ParseError(f"record {n} has {len(r)} fields, not {len(names)}")
    return names, records


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(uri, text, meta, error) of all records of the CSV and TSV files under path, files in parallel. A file that can't be
    parsed gives one row with its error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                try:
                    names, records = parse_csv(bytes(raw).decode("utf-8-sig", "replace"), "\t" if name.lower().endswith((".tsv", ".tab")) else ",", header)
                except ParseError as e:
                    yield pd.DataFrame({"uri": [name], "text": [None], "meta": [None], "error": [str(e)]})
                    continue
                rows = [(f"{name}#{n}", "\n".join(f"{c}: {v}" for c, v in zip(names, r) if v), dict(zip(names, r)) | {"row": str(n)}, None) for n, r in records]
                yield pd.DataFrame(rows, columns=["uri", "text", "meta", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "uri string, text string, meta map<string,string>, error string")
