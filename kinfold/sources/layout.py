"""Where the files of a split and the artifacts of a run are, over any store that Hadoop knows."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from . import store
from .tsv import SPLIT_FILES

ARTIFACTS = {"model": ("aliases", "model"), "train": ("train",), "test": ("test",)}


def find_split(spark: SparkSession, root, split: str, fallback=None) -> str:
    """The folder with all files of a split: fixed layouts, then a walk that follows links, then the fallback's walk."""
    wanted = set(SPLIT_FILES[split].values())
    for at in (f"{root}/{split}", f"{root}/dataset/{split}", f"{root}/data/{split}", str(root)):
        if all(store.exists(spark, f"{at}/{f}") for f in wanted):
            return at
    for top in filter(None, (root, fallback)):
        for at, folders, files in store.walk(spark, top):
            if wanted <= {*files, *folders}:
                return at
    raise FileNotFoundError(f"no folder with {', '.join(sorted(wanted))} in {root}")


def persist(spark: SparkSession, work, out, what: str = "all") -> list[str]:
    """Copies groups of artifacts (all, model, train or test) to ``out/artifacts``; returns what was copied."""
    names = [name for group in (ARTIFACTS if what == "all" else [what]) for name in ARTIFACTS[group]]
    found = [name for name in names if store.exists(spark, f"{work}/{name}")]
    for name in found:
        store.copy(spark, f"{work}/{name}", f"{out}/artifacts/{name}")
    return found


def restore(spark: SparkSession, root, work) -> list[str]:
    """Copies the first artifacts folder that holds aliases into ``work``; files that exist stay."""
    for top, folders, _ in store.walk(spark, root):
        if top.rsplit("/", 1)[-1] == "artifacts" and "aliases" in folders:
            files = sorted(f"{at}/{f}"[len(top) + 1 :] for at, _, fs in store.walk(spark, top) for f in fs)
            done = [f for f in files if not store.exists(spark, f"{work}/{f}")]
            for f in done:
                store.copy(spark, f"{top}/{f}", f"{work}/{f}")
            return done
    raise FileNotFoundError(f"no artifacts folder in {root}")


#: Of the source tree: what goes along, and what a package must have.
_KEPT = (".py", ".md", ".txt", ".toml")
_NEEDED = ("README.md", "requirements.txt", "METHOD.md")


def package(files: dict[str, str | Path], source: str | Path, target: str | Path) -> Path:
    """A zip of the named result files, README, requirements, method and the source tree; names all that is missing before it writes.

    The source tree is its Python and text files: no hidden folders, caches or data. Local paths, as the zip is for upload.
    """
    source, target = Path(source), Path(target)
    missing = [name for name, path in files.items() if not Path(path).is_file()] + [name for name in _NEEDED if not (source / name).is_file()]
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))
    hidden = lambda p: any(x.startswith(".") or x == "__pycache__" for x in p.relative_to(source).parts)
    code = [p for p in sorted(source.rglob("*")) if p.is_file() and p.suffix in _KEPT and not hidden(p)]
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, path in files.items():
            z.write(path, f"output/{name}")
        for part in code:
            z.write(part, f"src/{part.relative_to(source)}")
    return target
