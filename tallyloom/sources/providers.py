"""Providers of documents' cells by kind of file, and what a teacher is told of files that none can read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.sources import readers


@dataclass(frozen=True)
class Provider:
    """Reads files(path, content) with one of suffixes into rows of readers.CELLS, a row with an error for each file that it can't read.

    Providers with the same read get their files from it in one pass; such a read leaves paths as they are. Without read, its files are known but can't be read here; warning is the code that says why.
    """

    name: str
    suffixes: tuple[str, ...]
    read: Callable[[DataFrame], DataFrame] | None = None
    warning: str = "UNREADABLE"


class Providers:
    """Providers by name; a suffix goes to the one that was added last for it."""

    def __init__(self, *providers: Provider):
        self.known: dict[str, Provider] = {}
        for p in providers:
            self.add(p)

    def add(self, provider: Provider) -> None:
        self.known.pop(provider.name, None)
        self.known[provider.name] = provider

    def of_suffix(self) -> dict[str, str]:
        return {s: p.name for p in self.known.values() for s in p.suffixes}

    def cells(self, files: DataFrame) -> DataFrame:
        """provider and cells of files(path, content): each file's cells, or one row without a cell whose error says why there are none.

        A file whose provider can't read has its provider's warning, one of no provider NO_PROVIDER; these stay as a placeholder row, so that no file is lost. A file that a provider fails to
        read has its warning and what went wrong. Null paths are of no provider.
        """
        owners = self.of_suffix()
        reads: dict[Callable[[DataFrame], DataFrame], list[Provider]] = {}
        for p in self.known.values():
            if p.read is not None:
                reads.setdefault(p.read, []).append(p)

        def of_path(values: dict[str, str]) -> Column:
            """values by provider for the path's, which is looked up once for a row."""
            pairs = [F.lit(x) for s, owner in owners.items() if owner in values for x in (s, values[owner])]
            return F.create_map(*pairs)[text.suffix(F.coalesce("path", F.lit("")))] if pairs else F.lit(None).cast("string")

        unread = [p for p in self.known.values() if p.read is None]
        nothing = [F.lit(None).cast("int").alias(c) for c in ("table_ix", "row_ix", "cell_ix")]
        error = F.coalesce(of_path({p.name: p.warning for p in unread}), F.lit("NO_PROVIDER"))
        out = files.where(of_path({p.name: p.name for own in reads.values() for p in own}).isNull()).select(of_path({p.name: p.name for p in unread}).alias("provider"), "path", *nothing, F.lit(None).cast("string").alias("text"), error.alias("error"))
        for read, own in reads.items():
            found = read(files.where(of_path({p.name: p.name for p in own}).isNotNull()).select("path", "content"))
            name, warning = (F.lit(own[0].name), F.lit(own[0].warning)) if len(own) == 1 else (of_path({p.name: p.name for p in own}), of_path({p.name: p.warning for p in own}))
            out = out.unionByName(found.withColumn("error", F.when(F.col("error").isNotNull(), F.concat(warning, F.lit(": "), F.col("error")))).withColumn("provider", name))
        return out


#: Files of zipped formats and pages are read; those that need a PDF library or a model are told apart.
PROVIDERS = Providers(
    Provider("docx", ("docx",), readers.cells), Provider("sheet", ("xlsx",), readers.cells), Provider("page", ("html", "htm"), readers.cells), Provider("old-sheet", ("xls",), warning="SAVE_AS_XLSX"),
    Provider("pdf", ("pdf",), warning="NEEDS_TEXT_LAYER"), Provider("image", ("jpg", "jpeg", "png"), warning="NEEDS_OCR"),
)


def documents(cells: DataFrame) -> DataFrame:
    """path, provider, tables, cells (that have text) and warning of Providers.cells(), a row for each file."""
    said = F.coalesce(F.trim("text"), F.lit("")) != ""
    # counted by hash before there is a greatest text, for which Spark would sort all cells
    tables = cells.groupBy("path", "provider", "table_ix", "error").agg(F.count_if(said).alias("cells"))
    return tables.groupBy("path").agg(F.max("provider").alias("provider"), F.countDistinct("table_ix").alias("tables"), F.sum("cells").alias("cells"), F.max("error").alias("warning"))
