"""Raw records -> validated TSV collection (the convert + validate flow).

Source records are flattened and length-filtered (S3/S4/S5 rules), numbered densely in input
order (O1), written as ``id<TAB>text`` lines (K1), and the written files are validated in one
aggregation (A1).  Returns the validation row with the collection path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinals import dense_id
from ..operators.validate import validate_collection
from ..sinks.corpus import write_collection
from ..sources.corpus import LINE_ORDER, read_lines


def prepare_collection(spark: SparkSession, accepted: DataFrame, path: str, order_by: list[str] | str,
                       check_lines: int = 0) -> DataFrame:
    """``accepted`` holds flattened, filtered texts (any reader of ``sources.corpus``)."""
    write_collection(accepted, path, order_by)
    lines = read_lines(spark, path)
    if check_lines:
        numbered = dense_id(lines, LINE_ORDER, name="__line", start=1, bucket_prefix=2)
        summary = validate_collection(numbered, check_lines=check_lines, line_no_col="__line")
    else:
        summary = validate_collection(lines)
    return summary.withColumn("path", F.lit(path))
