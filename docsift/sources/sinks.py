"""Text files under chosen names, and manifests."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def write_texts(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (pos, path, text) as UTF-8 files below folder, which all executors share, and returns (pos, path, error).

    A file is written under a temporary name and moved into place, so a repeated task leaves whole files.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            paths, errors = [], []
            for pos, path, text in zip(frame["pos"], frame["path"], frame["text"], strict=True):
                target = os.path.join(folder, path)
                try:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.{os.getpid()}-{pos}.part"
                    with open(part, "w", encoding="utf-8") as out:
                        out.write(text)
                    os.replace(part, target)
                    errors.append(None)
                except OSError as e:
                    errors.append(f"{type(e).__name__}: {e}")
                paths.append(target)
            yield pd.DataFrame({"pos": frame["pos"], "path": paths, "error": errors})

    return rows.select("pos", "path", "text").mapInPandas(run, "pos long, path string, error string")
