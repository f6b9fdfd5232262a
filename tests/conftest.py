import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


FILES = "repo string, path string, dir string, name string, is_dir boolean, is_symlink boolean, size bigint, content binary"


def file_rows(tree: dict, repo: str = "r") -> list[tuple]:
    """Rows of a `files` table from path -> text, bytes, or None for a directory."""
    rows = []
    for path, content in tree.items():
        where, _, name = path.rpartition("/")
        data = content.encode() if isinstance(content, str) else content
        rows.append((repo, path, where or ".", name, data is None, False, None if data is None else len(data), data))
    return rows


@pytest.fixture()
def make_files(spark):
    return lambda tree, repo="r": spark.createDataFrame(file_rows(tree, repo), FILES)
