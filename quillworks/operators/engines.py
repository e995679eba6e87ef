"""Recognition engines behind one interface: rows of images in, rows of blocks out."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

BLOCKS = "image_id string, pos int, bbox array<array<double>>, text string, confidence double, error string"
#: name -> maker of a reader; the reader maps an image row to (bbox, text, confidence) or (bbox, text) tuples.
_makers: dict[str, Callable[[], Callable]] = {}


def register(name: str, maker: Callable[[], Callable]) -> None:
    _makers[name] = maker


def available() -> list[str]:
    return sorted(_makers)


def register_optional(name: str, module: str, maker: Callable[[object], Callable]) -> bool:
    """Registers an engine that needs a module from outside, if that is there; the reader is made from the module where it runs. False: it is not, and nothing changes."""
    if importlib.util.find_spec(module) is None:
        return False
    register(name, lambda: maker(importlib.import_module(module)))
    return True


#: What the stub reads from any image; one score more than words.
STUB_TEXT, STUB_SCORES = "샘플 텍스트", (0.8, 0.9, 0.7)
#: Reading parameters by use: book pages, safe reading, and none where the safe ones fail.
PARAMETERS = {
    "page": {"detail": False, "width_ths": 0.9, "height_ths": 0.9, "paragraph": True, "x_ths": 0.3, "y_ths": 0.3},
    "safe": {"width_ths": 0.7, "height_ths": 0.7, "mag_ratio": 1.5, "slope_ths": 0.1, "ycenter_ths": 0.5, "x_ths": 1.0, "y_ths": 0.5, "text_threshold": 0.7, "low_text": 0.4, "link_threshold": 0.4, "canvas_size": 2560, "paragraph": True},
    "plain": {},
}


def stub() -> Callable:
    """The stub's words with their scores; the score too many goes."""
    box = [[0.0, 0.0], [100.0, 0.0], [100.0, 20.0], [0.0, 20.0]]
    return lambda image: [(box, word, score) for word, score in zip(STUB_TEXT.split(), STUB_SCORES, strict=False)]


register("stub", stub)


def recognise(images: DataFrame, engine: str, fallback: str | None = None) -> DataFrame:
    """Blocks of each image. A Python worker makes the reader once; an engine that fails gives way to ``fallback``, else an error row."""
    first, second = _makers[engine], _makers.get(fallback) if fallback else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = [m() for m in (first, second) if m]
        for batch in batches:
            rows = []
            for image in batch.to_dict("records"):
                error = None
                for read in readers:
                    try:
                        blocks = [(image["image_id"], k, b[0], b[1], b[2] if len(b) > 2 else None, None) for k, b in enumerate(read(image)) if len(b) >= 2]
                        break
                    except Exception as e:  # an engine may fail in any way; the row says how
                        error = f"{type(e).__name__}: {e}"
                else:
                    blocks = [(image["image_id"], None, None, None, None, error)]
                rows += blocks
            yield pd.DataFrame(rows, columns=["image_id", "pos", "bbox", "text", "confidence", "error"]).astype({"pos": "Int32"})

    return images.mapInPandas(run, BLOCKS)
