"""Sinks: Markdown files with front matter, and catalogs as YAML beside Parquet."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.media import from_yaml, to_yaml


def page_text(front: dict, body: str) -> str:
    return f"---\n{to_yaml(front)}---\n\n{body}"


def split_page(text: str) -> tuple[dict, str]:
    """Front matter and body of a page file; without front matter all is body."""
    if not text.startswith("---\n") or "\n---\n" not in text:
        return {}, text
    head, _, body = text[4:].partition("\n---\n")
    return from_yaml(head) or {}, body.removeprefix("\n")


def other_form(path: str) -> str | None:
    """The other file a page may have been written to: ``a/x.md`` for ``a/x/_index.md`` and the reverse; none for the root's index."""
    folder, _, name = path.rpartition("/")
    if name == "_index.md":
        return f"{folder}.md" if folder else None
    return f"{path.removesuffix('.md')}/_index.md"


def delete_pages(stale: DataFrame, root: str, path: str = "path") -> int:
    """Delete the named Markdown files, those inside the folder only, and folders that are empty then; the number deleted."""
    top = Path(root).resolve()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = 0
            for name in batch[path]:
                target = (top / name).resolve()
                if target.suffix == ".md" and top in target.parents and target.is_file():
                    target.unlink()
                    n += 1
                    for folder in target.parents:
                        if folder == top or any(folder.iterdir()):
                            break
                        folder.rmdir()
            yield pd.DataFrame({"n": [n]})

    return stale.where(F.col(path).isNotNull()).select(path).distinct().mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_folder_indexes(folders: DataFrame, root: str, name: str = "_index.yaml") -> int:
    """One YAML file for each folder from rows as ``folder_index`` makes them; the number written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                target = Path(root) if row["path"] == "." else Path(root, row["path"])
                target.mkdir(parents=True, exist_ok=True)
                pages = [dict(p) for p in (row["pages"] if row["pages"] is not None else [])]
                front = {"path": row["path"], "title": row["title"], "children": list(row["children"]), "pages": pages, "keywords": list(row["keywords"]) if row["keywords"] is not None else []}
                (target / name).write_text(to_yaml(front), encoding="utf-8")
            yield pd.DataFrame({"n": [len(batch)]})

    return folders.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_root_markers(roots: DataFrame, root: str, name: str = ".doc-root.yaml") -> int:
    """A marker file in each of the folders, where there is none yet; the number written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = 0
            for folder in batch["folder"]:
                target = (Path(root) if folder == "." else Path(root, folder)) / name
                target.parent.mkdir(parents=True, exist_ok=True)
                if not target.exists():
                    title = target.parent.name or "docs"
                    target.write_text(f"title: {title}\nsyntax: XML\nsupportedLanguages: []\nproperties: []\n", encoding="utf-8")
                    n += 1
            yield pd.DataFrame({"n": [n]})

    return roots.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_pages(pages: DataFrame, root: str, path: str = "path", body: str = "markdown") -> int:
    """Write one file for each page from the tasks that hold the rows, into a folder all of them share; the number written.

    A page's index file and its plain file never stand side by side.
    """
    columns = [c for c in pages.columns if c != body]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                target = Path(root, row[path])
                target.parent.mkdir(parents=True, exist_ok=True)
                other = other_form(row[path])
                if other and Path(root, other).is_file():
                    Path(root, other).unlink()
                front = {c: v.tolist() if hasattr(v, "tolist") else v for c, v in ((c, row[c]) for c in columns)}
                part = target.with_name(f".{target.name}.{os.getpid()}")
                part.write_text(page_text({k: None if isinstance(v, float) and v != v else v for k, v in front.items()}, row[body] or ""), encoding="utf-8")
                part.replace(target)
            yield pd.DataFrame({"n": [len(batch)]})

    return pages.mapInPandas(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_catalog(rows: DataFrame, root: str, name: str) -> None:
    """A catalog table as Parquet."""
    rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}.parquet")


def append_history(report: DataFrame, root: str) -> None:
    """One more run in the history of synchronisations."""
    report.write.mode("append").parquet(f"{root.rstrip('/')}/sync_history.parquet")
