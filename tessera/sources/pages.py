"""Page text sources.

A document's pages are assembled in page order into one text (each non-empty page followed
by a blank line).  Only one document's pages meet in a group, so a group is bounded by the
size of one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

# pages of an output batch
_PAGES = 512

PAGE_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("page_text", T.StringType()),
])


def assemble_pages(pages: DataFrame, doc_col: str = "source_file", page_col: str = "page_no",
                   text_col: str = "page_text") -> DataFrame:
    """``(source_file, text)`` with the non-empty pages in page order, each + "\\n\\n"."""
    nonempty = pages.filter(F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"), F.col(text_col).alias("t"))))
    return (nonempty.groupBy(F.col(doc_col).alias("source_file"))
            .agg(ordered.alias("__pages"))
            .select("source_file",
                    F.concat(F.array_join(F.transform("__pages", lambda x: x["t"]), "\n\n"),
                             F.lit("\n\n")).alias("text")))


def _files(spark: SparkSession, directory: str, glob: str) -> DataFrame | None:
    """(path, content) of each matching file once (one listing, no shuffle); None without the directory."""
    ship_package(spark)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory).select("path", "content")


def _extracted(extract_pages, path: str, content) -> tuple[str, list, str | None]:
    """(file name, pages, error) of a file."""
    name = path.rsplit("/", 1)[-1]
    try:
        return name, list(extract_pages(bytes(content))), None
    except Exception as e:  # an unreadable file: no pages, but a row in the failure report
        return name, [], f"{type(e).__name__}: {e}"


def scan_document_dir(spark: SparkSession, directory: str,
                      extract_pages: Callable[[bytes], Iterable[str]],
                      glob: str = "*.{pdf,PDF}") -> DataFrame:
    """List ``*.pdf``/``*.PDF`` once and run the caller's page extractor per file inside
    ``mapInArrow``; a file that fails yields no pages and the run goes on (``scan_failures`` names
    it); a missing directory yields an empty table."""
    files = _files(spark, directory, glob)
    if files is None:
        return spark.createDataFrame([], PAGE_SCHEMA)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time
                name, pages, _ = _extracted(extract_pages, batch.column("path")[i].as_py(), batch.column("content")[i].as_py())
                for s in range(0, len(pages), _PAGES):
                    texts = pages[s:s + _PAGES]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(texts), pa.string()), pa.array(range(s + 1, s + 1 + len(texts)), pa.int32()), pa.array(texts, pa.string())],
                        names=PAGE_SCHEMA.names)

    return files.mapInArrow(run, PAGE_SCHEMA)


def scan_failures(spark: SparkSession, directory: str, extract_pages: Callable[[bytes], Iterable[str]],
                  glob: str = "*.{pdf,PDF}") -> DataFrame:
    """S8's report: (source_file, error) of the files that the extractor can't read."""
    schema = "source_file string, error string"
    files = _files(spark, directory, glob)
    if files is None:
        return spark.createDataFrame([], schema)

    def run(batches):
        for pdf in batches:
            found = [_extracted(extract_pages, path, content) for path, content in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame([(name, error) for name, _, error in found if error], columns=["source_file", "error"])

    return files.mapInPandas(run, schema)
