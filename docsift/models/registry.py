"""Which files a model needs, where they lie, and whether they are the pinned ones."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

#: Files of the structured recognizer by variant of its image encoder, and of the line recognizer.
VISION = {"q8": ("onnx/vision_encoder_q8.onnx",), "q4": ("onnx/vision_encoder_q4.onnx",)}
DEFAULT_VISION = "q8"
SHARED = ("onnx/decoder_q4.onnx", "onnx/embedding.onnx", "onnx/embedding.onnx.data", "tokenizer.json", "config.json")
LINES = ("det/inference.onnx", "det/inference.yml", "rec/inference.onnx", "rec/inference.yml")
#: Files that a folder may lack and still serve.
OPTIONAL = ("config.json",)


def model_files(vision: str = DEFAULT_VISION) -> tuple[str, ...]:
    """Files that a run with the variant needs."""
    if vision not in VISION:
        raise ValueError(f"vision must be one of {', '.join(VISION)}: {vision}")
    return (*VISION[vision], *SHARED)


def all_files() -> list[str]:
    """The files of all variants and models, each once, in order of first use."""
    return list(dict.fromkeys([*(f for files in VISION.values() for f in files), *SHARED, *(f"lines/{f}" for f in LINES)]))


def rows() -> list[tuple[str, str, bool]]:
    """(variant, file, required) of every variant, for a table."""
    return [(vision, file, file not in OPTIONAL) for vision in VISION for file in model_files(vision)]


def holds(folder: str, files: tuple[str, ...]) -> bool:
    return all(os.path.isfile(os.path.join(folder, f)) for f in files if f not in OPTIONAL)


def is_pinned(revision: str | None) -> bool:
    """Only a whole commit hash pins a revision; names of branches and short hashes move."""
    return bool(revision) and re.fullmatch("[0-9a-f]{40}", revision) is not None


@dataclass(frozen=True)
class Folder:
    """Where a model's files are. trusted: placed there by the user, so that no digest is asked for."""

    path: str
    trusted: bool


def find_folder(files: tuple[str, ...], given: str | None = None, beside: tuple[str, ...] = (), cache: str | None = None, revision: str | None = None) -> Folder:
    """The folder that the user gives, else the first one beside the program that holds all files, else the cache's.

    Nothing is fetched: workers of a cluster read models from a shared folder. The cache counts only for a pinned revision.
    """
    if given is not None:
        if not holds(given, files):
            raise FileNotFoundError(f"{given} lacks {', '.join(f for f in files if f not in OPTIONAL and not os.path.isfile(os.path.join(given, f)))}")
        return Folder(given, True)
    for folder in beside:
        if holds(folder, files):
            return Folder(folder, True)
    if cache is None or not holds(cache, files):
        raise FileNotFoundError(f"no folder holds {', '.join(files)}")
    if not is_pinned(revision):
        raise ValueError("the revision of cached models must be a commit hash of 40 digits")
    return Folder(cache, False)
