"""Pages of files by an injected reader, and boxes on pages by an injected model: the boundary to parsers and inference."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import in_selection

PAGE = "doc_id string, pageno int, width double, height double, rotate int, text string, blocks array<struct<type: int, bbox: array<double>>>, error string"
BOX = "doc_id string, pageno int, seq int, x0 double, y0 double, x1 double, y1 double, conf double, cls int"

_BLOCK = pa.struct([("type", pa.int32()), ("bbox", pa.list_(pa.float64()))])
_PAGE = pa.schema([("doc_id", pa.string()), ("pageno", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("rotate", pa.int32()), ("text", pa.string()), ("blocks", pa.list_(_BLOCK)), ("error", pa.string())])
#: Files whose pages are in one batch.
_AT_ONCE = 64

#: content -> (width, height, rotate, text, blocks) of each page; blocks are (type, [x0, y0, x1, y1]).
Reader = Callable[[bytes], Iterable[tuple[float, float, int, str, list]]]
_models: dict[str, object] = {}


def scan(files: DataFrame, reader: Reader, selection: Column | None = None) -> DataFrame:
    """The selected pages of files (doc_id, content), numbered from 0; a null or empty selection means all.

    A file that the reader fails on gives one row of page -1 with the error, and fails no task. Null contents have no pages.
    """

    def pages(doc: str, content: bytes | None) -> Iterator[tuple]:
        if content is None:
            return
        try:
            for n, (width, height, rotate, text, blocks) in enumerate(reader(content)):
                yield doc, n, float(width), float(height), int(rotate), text, [{"type": k, "bbox": b} for k, b in blocks], None
        except Exception as e:  # noqa: BLE001  a broken file is its own row
            yield doc, -1, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, _AT_ONCE):
                docs, contents = (part.column(c).slice(at, _AT_ONCE).to_pylist() for c in ("doc_id", "content"))
                rows = [r for doc, content in zip(docs, contents, strict=True) for r in pages(doc, content)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGE, strict=True)], schema=_PAGE)

    out = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, PAGE)
    if selection is not None:
        out = out.where((F.col("pageno") < 0) | in_selection(F.col("pageno"), selection))
    return out


def detected(images: DataFrame, name: str, load: Callable[[], Callable[[bytes], Iterable[tuple]]]) -> DataFrame:
    """Boxes (x0, y0, x1, y1, conf, cls) of images (doc_id, pageno, image). The model is loaded once in each worker, by name."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _models:
            _models[name] = load()
        model = _models[name]
        for pdf in parts:
            rows = [(d, p, i, *map(float, b[:5]), int(b[5])) for d, p, image in zip(pdf["doc_id"], pdf["pageno"], pdf["image"], strict=True) if image is not None for i, b in enumerate(model(bytes(image)))]
            yield pd.DataFrame(rows, columns=["doc_id", "pageno", "seq", "x0", "y0", "x1", "y1", "conf", "cls"])

    return images.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("pageno").cast("int").alias("pageno"), "image").mapInPandas(run, BOX)
