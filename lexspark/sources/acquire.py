"""Getting files: downloads by the executors, and glyphs of PDF files where a PDF reader is installed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lexspark.sources import schemas

#: Tasks that fetch at once, at most.
MOST_FETCHING = 256


def fetch(wanted: DataFrame, tries: int = 3, timeout: float = 60.0) -> DataFrame:
    """(file_name, url, content, error) of `wanted` (file_name, url), fetched by the executors, a file at a time in
    each task. Redirects are followed; a failed connection, a timeout and a server's error are tried
    again after a pause that doubles, a client's error is not. What failed has null content and the error."""

    def get(url: str) -> tuple[bytes | None, str | None]:
        import time
        import urllib.error
        import urllib.request

        for n in range(tries):
            try:
                with urllib.request.urlopen(url, timeout=timeout) as got:  # noqa: S310
                    return got.read(), None
            except urllib.error.HTTPError as e:
                error = f"HTTP {e.code}"
                if e.code < 500:
                    break
            except (OSError, ValueError) as e:
                error = str(e)
            if n + 1 < tries:
                time.sleep(0.5 * 2**n)
        return None, error

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, url in zip(part.file_name, part.url, strict=True):
                content, error = get(url)
                yield pd.DataFrame({"file_name": [name], "url": [url], "content": [content], "error": [error]})

    tasks = max(1, min(MOST_FETCHING, wanted.count()))
    rows = wanted.select("file_name", "url").repartition(tasks)
    return rows.mapInPandas(run, "file_name string, url string, content binary, error string")


def read_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """Glyphs of the PDF files of a folder, see `glyphs_of`."""
    return glyphs_of(spark.read.format("binaryFile").load(path))


def glyphs_of(files: DataFrame) -> DataFrame:
    """Glyphs of PDF files (content), one file a row group. Needs pdfplumber on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pdfplumber
        except ImportError as e:
            raise RuntimeError("reading PDF files needs pdfplumber; glyph tables can be read without it") from e
        from io import BytesIO

        for part in parts:
            for content in part.content:
                with pdfplumber.open(BytesIO(content)) as pdf:
                    for number, page in enumerate(pdf.pages, 1):
                        rows = [
                            (number, i, k, c["text"], c["size"], c["x0"], c["x1"], c["bottom"])
                            for i, line in enumerate(page.extract_text_lines(return_chars=True))
                            for k, c in enumerate(line["chars"])
                        ]
                        yield pd.DataFrame(rows, columns=schemas.struct(schemas.GLYPH).names)

    return files.select("content").mapInPandas(run, schemas.GLYPH)
