"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Texts are long: batches for Python are bounded by bytes, so that a worker's memory does not follow the length of rows.
BATCH_BYTES = 16 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable on every executor, once per application, and bounds what one Arrow batch holds."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(bound).rstrip("bB") or 0) > BATCH_BYTES:
        spark.conf.set(bound, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="papyra-zip-")) / "papyra.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(target))
    return spark
