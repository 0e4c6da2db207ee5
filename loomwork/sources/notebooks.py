"""Notebook documents: code cells, stripped outputs, plain-script form."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

_CELL = "struct<cell_type: string, source: string, input: string>"
NOTEBOOK = (
    f"nbformat int, cells array<{_CELL}>, worksheets array<struct<cells: array<{_CELL}>>>"
)
# a source may be a list of lines instead of one string
NOTEBOOK_LINES = NOTEBOOK.replace("source: string, input: string",
                                  "source: array<string>, input: array<string>")


def _parsed_cells(raw: Column, schema: str) -> Column:
    nb = F.from_json(raw, schema)
    old = F.flatten(F.transform(nb["worksheets"], lambda w: w["cells"]))
    return F.when(F.coalesce(nb["nbformat"], F.lit(4)) < 4, old).otherwise(nb["cells"])


def cell_sources(raw: Column) -> Column:
    """Array of struct(pos, source) with the non-empty code cells in document order.

    Layouts before version 4 keep cells in worksheets and code in `input`.
    """
    text = F.transform(
        _parsed_cells(raw, NOTEBOOK),
        lambda c, i: F.struct(
            i.alias("pos"), c["cell_type"].alias("kind"),
            F.coalesce(c["source"], c["input"]).alias("source"),
        ),
    )
    joined = F.transform(
        _parsed_cells(raw, NOTEBOOK_LINES),
        lambda c, i: F.array_join(F.coalesce(c["source"], c["input"]), ""),
    )
    # a list of lines reads as its JSON text under the string schema
    merged = F.transform(
        text,
        lambda c: F.struct(
            c["pos"].alias("pos"), c["kind"].alias("kind"),
            F.coalesce(
                F.when(c["source"].startswith("["), F.get(joined, c["pos"])), c["source"]
            ).alias("source"),
        ),
    )
    code = F.filter(merged, lambda c: (c["kind"] == "code") & (F.length(c["source"]) > 0))
    return F.transform(code, lambda c: F.struct(c["pos"], c["source"]))


def notebook_cells(notebooks: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per non-empty code cell: (other columns..., cell, source)."""
    kept = [c for c in notebooks.columns if c != raw]
    return notebooks.select(*kept, F.inline(cell_sources(F.col(raw)))).withColumnRenamed(
        "pos", "cell"
    )


@F.pandas_udf(T.StringType())
def strip_notebook_outputs(raw: pd.Series) -> pd.Series:
    """Notebook text without signature, outputs and prompt numbers; other keys survive."""

    def strip(text):
        try:
            nb = json.loads(text)
        except (TypeError, ValueError):
            return None
        if not isinstance(nb, dict):
            return None  # JSON, but no notebook
        if isinstance(nb.get("metadata"), dict):
            nb["metadata"].pop("signature", None)
        version = nb.get("nbformat", 4)
        sheets = [nb]
        if isinstance(version, (int, float)) and version < 4:
            sheets = nb.get("worksheets") or []
        cells = [
            c for sheet in sheets if isinstance(sheet, dict) for c in sheet.get("cells") or []
        ]
        for cell in cells:
            if not isinstance(cell, dict):
                continue
            if "outputs" in cell:
                cell["outputs"] = []
            if "prompt_number" in cell:
                cell["prompt_number"] = None
        return json.dumps(nb, ensure_ascii=False, sort_keys=True)

    return raw.map(strip)


def notebook_to_script(notebooks: DataFrame, raw: str = "raw") -> DataFrame:
    """Replace notebook text by its code cells as one script (`code`, language, ext)."""
    sources = F.transform(cell_sources(F.col(raw)), lambda c: c["source"])
    kept = [c for c in notebooks.columns if c != raw]
    return notebooks.select(
        *kept, F.array_join(sources, "\n\n").alias("code"),
        F.lit("Python").alias("language"), F.lit("py").alias("ext"),
    )
