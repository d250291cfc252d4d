"""Assets of local pages: copied beside their pages, measured, and recorded."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.media import image_size
from inkloom.sources.local import local_target

ASSETS = "url string, source string, kind string, alt string, local_path string, width int, height int, problem string"


def materialise(assets: DataFrame, root: str, output: str) -> DataFrame:
    """``url, source, kind, alt, local_path, width, height, problem`` of the assets of local pages.

    ``assets``: ``url, page`` (the source file), ``source, kind, alt, target`` (where the copy goes).  Files are copied
    by the tasks that hold the rows, into a folder all of them share; a copy that is there and isn't empty stays.  What
    lies outside the source or on the web isn't fetched and has no local path; ``problem``: ``asset_missing`` for a file
    that isn't there.  Sizes are those of PNG, GIF and JPEG headers.
    """
    names = [c.split(" ")[0] for c in ASSETS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, page, source, kind, alt, target in batch[["url", "page", "source", "kind", "alt", "target"]].itertuples(index=False, name=None):
                own = local_target(source, page, root)
                path = Path(root, own) if own else None
                if path is None or not path.is_file():
                    rows.append((url, source, kind, alt, None, None, None, "asset_missing" if own else None))
                    continue
                data, copy = path.read_bytes(), Path(output, target)
                if not copy.is_file() or not copy.stat().st_size:
                    copy.parent.mkdir(parents=True, exist_ok=True)
                    part = copy.with_name(f".{copy.name}.{os.getpid()}")
                    part.write_bytes(data)
                    part.replace(copy)
                rows.append((url, source, kind, alt, target, *(image_size(data) or (None, None)), None))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"width": "Int32", "height": "Int32"})

    first = assets.groupBy("url", "source").agg(F.min(F.struct("page", "kind", "alt", "target")).alias("a")).select("url", "source", "a.*")
    return first.mapInPandas(run, ASSETS)
