"""Analytics on document packages and training corpora as Spark jobs."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

_SHIPPED: dict[str, str] = {}
#: Rows that a Python worker is sent at a time, where the session doesn't say: whole texts of these fit beside a tokenizer.
BATCH = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark) -> None:
    """Sends this package to the executors once per application, as --py-files would, and bounds the batches of Python workers."""
    context = spark.sparkContext
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH))
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(prefix="foliograph-ship-")) / "foliograph.zip"
    path.write_bytes(data.getvalue())
    context.addPyFile(str(path))
    _SHIPPED[context.applicationId] = str(path)
